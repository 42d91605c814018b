"""Language identification as a mixture: how much of each document is in which language."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType, DoubleType

from glossmill.llm.common import crc_mod, table

#: Letter trigrams are hashed into so many buckets.
BUCKETS = 1 << 13
#: Documents of each language that the trigram models are fitted on, about, at most. All documents are scored.
ROWS_PER_LANGUAGE = 1500
SMOOTHING = 0.5
#: Languages whose counts a task holds before it sends them on.
AT_ONCE = 256
ROUNDS = 30
#: What a further language must add to the log-likelihood, times half the log of the number of trigrams.
PENALTY = 2.0
#: Characters that one vectorised step handles.
STEP = 1 << 20
HELD, OF = 0, 5
UNKNOWN = "und"


def padded(text: str) -> str:
    """The lower-cased text between two word boundaries; no NUL is left in it."""
    return f" {text.lower().replace(chr(0), ' ')} "


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every trigram of letters and word boundaries around a letter; texts are padded, or parts of such."""
    codes = np.frombuffer(chr(0).join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = codes == 0
    number = np.cumsum(edge).astype(np.int32)
    used, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in used.tolist()], dtype=bool)
    kept = np.where(letter, used, 32).astype(np.uint64)[at]
    a, b, c = kept[:-2], kept[1:-1], kept[2:]
    real = (b != 32) & ~edge[:-2] & ~edge[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    return number[:-2][real], (mixed[real] % np.uint64(BUCKETS)).astype(np.int64)


def counted(text: str, step: int = STEP) -> np.ndarray:
    """How often each bucket occurs in a whole text, `step` trigrams at a time, so that memory does not grow with the text's."""
    whole = padded(text)
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(whole) - 2, step):
        counts += np.bincount(trigrams([whole[i : i + step + 2]])[1], minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    """Chance of each trigram bucket in each language, languages in code point order."""

    languages: tuple[str, ...]
    chances: np.ndarray  # languages x buckets, of 32 bits

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        some: list[int] = []
        size = 0
        for k, text in enumerate([*texts, None]):
            if text and len(text) > STEP:
                found[k] = self.predict(counted(text))
            elif text:
                some.append(k)
                size += len(text)
            if some and (size >= STEP or k == len(texts)):
                number, bucket = trigrams([padded(texts[i]) for i in some])
                ends = np.searchsorted(number, np.arange(len(some) + 1))
                for n, i in enumerate(some):
                    found[i] = self.predict(np.bincount(bucket[ends[n] : ends[n + 1]], minlength=BUCKETS))
                some, size = [], 0
        return found

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        seen = np.flatnonzero(counts)
        if not len(seen):
            return UNKNOWN, 0.0
        shares = select_languages(self.chances[:, seen].astype(np.float64), counts[seen].astype(np.float64))
        best = int(np.argmax(shares))
        return self.languages[best], float(min(1.0, shares[best]))


def mixture(chances: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the languages' shares, and the log-likelihood they reach."""
    total = counts.sum()
    for _ in range(ROUNDS):
        weighed = counts / (shares @ chances)
        new = shares * (chances @ weighed) / total
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(counts @ np.log(shares @ chances))


def select_languages(chances: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of the languages, 0 for those not in the chosen set.

    Starts from the most likely single language and adds the one that raises the log-likelihood most, as long as the gain is
    above PENALTY * log(trigrams) / 2. The gradient at the present mixture names the language to try next.
    """
    alone = np.log(chances) @ counts
    chosen = [int(np.argmax(alone))]
    shares, best = np.ones(1), float(alone[chosen[0]])
    price = PENALTY * 0.5 * np.log(max(counts.sum(), 2.0))
    while len(chosen) < len(chances):
        gain = chances @ (counts / (shares @ chances[chosen])) / counts.sum()
        gain[chosen] = 0.0
        nxt = int(np.argmax(gain))
        if gain[nxt] <= 1.0:
            break
        tried = [*chosen, nxt]
        new, reached = mixture(chances[tried], counts, np.append(shares * 0.8, 0.2))
        if reached - best <= price:
            break
        chosen, shares, best = tried, new, reached
    out = np.zeros(len(chances))
    out[chosen] = shares
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of each language, given by its number, in a partition; those of many languages are told on the way."""
    counts: dict[int, np.ndarray] = {}

    def told() -> Iterator[pd.DataFrame]:
        for lang, own in counts.items():
            seen = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": own[seen]})
        counts.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            own = counts.setdefault(int(lang), np.zeros(BUCKETS, np.int64))
            for text in texts:
                own += counted(text)
            if len(counts) >= AT_ONCE:
                yield from told()
    yield from told()


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Trigram models of all languages, from documents with a language whose crc32 of the id modulo OF is not HELD.

    About `rows` documents of each language are taken, those with the smallest hashes of their ids. BUCKETS numbers a language
    come to the driver, 32 KiB.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), OF) != HELD))
    per = {r["lang"]: min(1.0, rows / r["count"]) for r in usable.groupBy("lang").count().collect()}
    if not per:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32))
    rate = F.from_json(F.lit(json.dumps(per)), "map<string,double>")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = usable.filter(F.col("text").isNotNull() & (draw < rate[F.col("lang")])).select("lang", "text")
    languages = sorted(per)
    number = F.from_json(F.lit(json.dumps({lang: k for k, lang in enumerate(languages)})), "map<string,long>")
    counts = texts.select(number[F.col("lang")].alias("lang"), "text").mapInPandas(_count, "lang long, bucket long, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    chances = np.full((len(languages), BUCKETS), SMOOTHING, np.float32)
    chances[found["lang"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float32)
    chances /= chances.sum(1, keepdims=True, dtype=np.float64)
    return LanguageModel(tuple(languages), chances)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row, for whole texts.

    score is the share of the text's trigrams that the mixture gives to the language. Texts that are null or have no letter
    get `und` and 0, as does everything where no language was learned. Ties go to the language that comes first by code
    point. Equal rows score alike; an empty table gives no rows.
    """
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.scores(batch.tolist()), columns=["lang", "score"])

    return docs.select("doc_id", predict("text").alias("_p")).select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (crc_mod(F.col("doc_id"), OF) == HELD).alias("held_out"), "lang_pred", "score")
