"""Quality by compression: which of two dictionaries, of good or of bad text, makes a document smaller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from glossmill.llm.common import crc_mod, table
from glossmill.llm.training import ROWS_PER_LABEL, fit_logistic, labelled_sample, sigmoid

DICTIONARY = 64 << 10
#: Texts are compressed in pieces of so many bytes, each with the dictionary alone before it.
PIECE = 2048
LEVEL = 3
#: Pieces of each label that a dictionary is trained on.
PIECES = 4000
THRESHOLD = 0.5


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    samples = [p for t in texts for p in pieces(t)][:PIECES]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(bad - good) / (bad + good) for the compressed sizes of the whole text, and the log of how far either shrinks it."""
    parts = pieces(text)
    if not parts:
        return 0.0, 0.0
    g, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
    return (b - g) / (b + g), log((b + g) / (2 * sum(map(len, parts))))


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Callable[[pd.Series], np.ndarray]:
        if not self.good or not self.bad:
            return lambda texts: np.full(len(texts), float(sigmoid(np.array(self.weights[-1]))))
        good, bad = compressor(self.good), compressor(self.bad)
        w = np.array(self.weights)

        def score(texts: pd.Series) -> np.ndarray:
            x = np.array([features(t, good, bad) for t in texts]).reshape(-1, 2)
            return sigmoid(x @ w[:-1] + w[-1])

        return score


def fit(sample: list[tuple[str, int]]) -> QualityModel:
    """Dictionaries from every second text, calibration on the others. Without both labels the score is the labels' share."""
    train, rest = sample[::2], sample[1::2]
    good, bad = (dictionary([t for t, y in train if y == want]) for want in (1, 0))
    share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
    if not good or not bad or len({y for _, y in rest}) < 2:
        return QualityModel(b"", b"", (0.0, 0.0, log(share / (1 - share))))
    g, b = compressor(good), compressor(bad)
    x, y = np.array([features(t, g, b) for t, _ in rest]), np.array([y for _, y in rest], dtype=float)
    return QualityModel(good, bad, tuple(fit_logistic(x, y)))


def scorer_udf(model: QualityModel):
    @pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in texts:
            yield pd.Series(scorer(batch))

    return score


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per input row, for whole texts.

    The score is from 0 to 1; null and empty texts compress to nothing and get the intercept's score. Equal rows score alike;
    an empty table gives no rows.
    """
    return docs.select("doc_id", scorer_udf(model)("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, as they came in."""
    return docs.filter(scorer_udf(model)("text") >= threshold)


def trained(spark: SparkSession, sf_dir: str, rows: int = ROWS_PER_LABEL) -> QualityModel:
    return fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", rows))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
