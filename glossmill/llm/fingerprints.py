"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line of a text, as it is. It becomes a wide vector of two parts: EXACT lanes of its 512-bit digest, and LANES
lanes into which each of its word pairs adds or takes one. A fingerprint is the sum of its paragraphs' vectors, every lane
modulo 2^64, so

- the order of paragraphs does not matter, their repeats do;
- a paragraph is put in or taken out by adding or subtracting its vector, without the rest of the text;
- fingerprints of parts add up to that of the whole, whatever the parts are.

The exact lanes tell texts apart. The squared length of the other lanes' difference estimates how many word pairs two texts do
not share, and likeness() is one minus its share of both texts' own, as the shared part of two multisets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from glossmill.llm.common import cut, settled, table

#: Lanes of the exact part (64 bits each) and of the part for likeness; the estimate's error falls with the root of LANES.
EXACT, LANES = 8, 512
WIDTH = EXACT + LANES
#: Bytes of a word after which it goes on as another one, so that text without blanks has pieces too.
WORD = 16
SEED = 29

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_START = np.uint64(_hash(b""))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_DTYPES = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}


def paragraphs(text: str | None) -> list[str]:
    """The lines of a text, empty ones too; a null or empty text has none."""
    return text.split("\n") if text else []


def _words(paragraph: bytes) -> list[bytes]:
    words = paragraph.split()
    if len(paragraph) > WORD and words and max(map(len, words)) > WORD:
        return [w[k : k + WORD] for w in words for k in range(0, len(w), WORD)]
    return words


def vector(of: Iterable[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors, WIDTH lanes of 64 bits."""
    out = np.zeros(WIDTH, np.uint64)
    digests, hashes, starts = [], [], []
    for paragraph in of:
        raw = paragraph.encode("utf-8", "surrogatepass")
        digests.append(hashlib.blake2b(raw).digest())
        words = _words(raw)
        if words:
            starts.append(len(hashes))
            hashes.extend(map(_hash, words))
    if digests:
        out[:EXACT] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    if hashes:
        second = np.array(hashes, np.uint64)
        first = np.roll(second, 1)
        first[starts] = _START
        pairs = (first * _PRIME ^ second) * _PRIME
        pairs ^= pairs >> np.uint64(29)
        signs = 1.0 - 2.0 * (pairs >> np.uint64(63)).astype(np.float64)
        lanes = np.bincount((pairs >> np.uint64(32)).astype(np.int64) % LANES, signs, LANES)
        out[EXACT:] = lanes.astype(np.int64).view(np.uint64)
    return out


def text_vector(text: str | None) -> np.ndarray:
    return vector(paragraphs(text))


def packed(v: np.ndarray) -> bytes:
    """A vector's exact lanes, the bytes a lane takes, and the other lanes in as few bytes as hold them all."""
    lanes = v[EXACT:].view(np.int64)
    low, high = int(lanes.min()), int(lanes.max())
    width = next(w for w in _DTYPES if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return v[:EXACT].astype("<u8").tobytes() + bytes([width]) + lanes.astype(_DTYPES[width]).tobytes()


def written(v: np.ndarray) -> str:
    """packed() as text, in base 64."""
    return base64.b64encode(packed(v)).decode()


def read(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    lanes = np.frombuffer(raw, _DTYPES[raw[8 * EXACT]], LANES, 8 * EXACT + 1).astype(np.int64)
    return np.concatenate([np.frombuffer(raw, "<u8", EXACT), lanes.view(np.uint64)])


def vector_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, near 0 for texts without common word pairs."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].view(np.int64).astype(np.float64) for v in (a, b))
    both = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1 - float((x - y) @ (x - y)) / both)) if both else 0.0


def _strings(function, *columns: pd.Series) -> pd.Series:
    """function of each row's texts; null where any is null."""
    return pd.Series([None if any(x is None for x in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of each text; null counts as an empty text."""
    return pd.Series([written(text_vector(t)) for t in text], dtype=object)


@F.pandas_udf(StringType())
def added(one: pd.Series, other: pd.Series) -> pd.Series:
    """The fingerprint of two texts' paragraphs together."""
    return _strings(lambda a, b: written(read(a) + read(b)), one, other)


@F.pandas_udf(StringType())
def removed(one: pd.Series, other: pd.Series) -> pd.Series:
    """The fingerprint that is left of one when the paragraphs of the other are taken out."""
    return _strings(lambda a, b: written(read(a) - read(b)), one, other)


@F.pandas_udf(DoubleType())
def likeness(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.to_numeric(_strings(lambda a, b: vector_likeness(read(a), read(b)), one, other))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict = {}
        for key, text, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            v = vector([text or ""]) * np.int64(times).astype(np.uint64)
            sums[key] = sums[key] + v if key in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.schema.field(0).type), pa.array([written(v) for v in sums.values()], pa.string())], ["key", "part"])


@F.pandas_udf(StringType())
def total(parts: pd.Series) -> str:
    """The sum of fingerprints, as an aggregate; of none, the empty text's."""
    out = np.zeros(WIDTH, np.uint64)
    for part in parts:
        if part is not None:
            out += read(part)
    return written(out)


def updated(prints: DataFrame, changes: DataFrame, fan_in: int = 64) -> DataFrame:
    """(key, fingerprint) of prints(key, fingerprint) after changes(key, paragraph, times).

    times is how often a paragraph is put in, or taken out where negative; null counts as 0, a null paragraph as an empty one.
    A key without a fingerprint starts from the empty text. Changes are summed where they are read, and then over `fan_in`
    places before they meet, so that a key with many of them is no large group. Null keys are one key; of equal keys in
    prints, all fingerprints are summed. Tables without rows give the other one's rows.
    """
    kind = prints.schema["key"].dataType.simpleString()
    parts = changes.select(F.col("key").cast(kind).alias("key"), F.col("paragraph").cast("string"), F.coalesce(F.col("times").cast("long"), F.lit(0)).alias("times")).mapInArrow(_partial_sums, f"key {kind}, part string")
    some = parts.withColumn("_place", F.pmod(F.xxhash64("part"), F.lit(fan_in))).groupBy("key", "_place").agg(total("part").alias("part")).select("key", "part")
    both = prints.select("key", F.col("fingerprint").alias("part")).unionByName(some)
    return both.groupBy("key").agg(total("part").alias("fingerprint"))


def edit(text: str, following: str) -> tuple[str, int]:
    """(edited, same): the text with its last quarter replaced by as much of the following one, and how many first paragraphs stay."""
    n = len(text) // 4
    head = text[: len(text) - n]
    return (head + following[:n], head.count("\n")) if n else (text, len(paragraphs(text)))


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, n_paragraphs long"


def _compared(text: str, v: np.ndarray, following: str, w: np.ndarray) -> tuple:
    """The result of a text with vector v before a text with vector w. The edited text's vector comes from v by what changed."""
    edited, same = edit(text, following)
    u = v - vector(paragraphs(text)[same:]) + vector(paragraphs(edited)[same:])
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, packed(v), packed(u), vector_likeness(v, u), vector_likeness(v, w), len(paragraphs(text))


#: Kinds of rows that a range of documents gives: results, its first document, its last one.
_DONE, _FIRST, _LAST = 0, 1, 2


def _range_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a range's documents but the last one, and the texts at both of its ends."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    open_: tuple | None = None
    part = None

    def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        kinds = [kind, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "_kind", "_part", "_text", *names])

    none = (None,) * len(names)
    kind = None
    for batch in batches:
        kind, found = batch.schema.field(0).type, []
        for doc, text, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            v = text_vector(text)
            if open_ is None:
                found.append((doc, _FIRST, part, text, *none))
            else:
                found.append((open_[0], _DONE, part, None, *_compared(*open_[1:], text, v)))
            open_ = doc, text, v
        if found:
            yield rows(found, kind)
    if open_ is not None:
        yield rows([(open_[0], _LAST, part, open_[1], *none)], kind)


def _end_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    for batch in batches:
        texts = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        found = list(zip(*(_compared(a, text_vector(a), b, text_vector(b)) for a, b in texts), strict=True)) or [()] * len(names)
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], ["doc_id", *names])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs), one row per input row.

    The edited text is the text with its last quarter of code points replaced by the beginning of the next document's. Next is
    by ascending doc_id, null ids first, rows of one id in the order of a hash of their texts, the first one after the last.
    A null text counts as empty; equal rows each have their row; an only document is its own next one; an empty table gives no
    rows. The texts move once, into ranges of the order; each task walks through its range with one document held, and the
    ends of the ranges, two rows each, meet afterwards.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    ranged = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    walked = cut(ranged.select("doc_id", "text", F.spark_partition_id().alias("_part")).mapInArrow(_range_results, f"doc_id {kind}, _kind int, _part int, _text string, {_RESULT}"))
    firsts = walked.filter(F.col("_kind") == _FIRST).select(F.col("_part").alias("_of"), F.col("_text").alias("_next"))
    after = F.lead("_of").over(Window.orderBy("_of"))
    least = F.min("_of").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = firsts.select("_of").select(F.col("_of").alias("_part"), F.coalesce(after, least).alias("_to"))
    ends = walked.filter(F.col("_kind") == _LAST).select("doc_id", "_text", "_part").join(following, "_part").join(firsts, F.col("_to") == F.col("_of"))
    last = ends.select("doc_id", "_text", "_next").mapInArrow(_end_results, f"doc_id {kind}, {_RESULT}")
    text = lambda c: F.translate(F.base64(c), "\r\n", "").alias(c)  # noqa: E731  in one line, whatever the session's setting
    both = walked.filter(F.col("_kind") == _DONE).select(*last.columns).union(last)
    return both.select(*[text(c) if c.endswith("fingerprint") else c for c in both.columns])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column; a column named `out` is replaced."""
    return docs.withColumn(out, fingerprint(F.col(f"`{text}`").cast("string")))


def near(one: Column, other: Column, least: float) -> Column:
    """Whether two fingerprints are alike enough."""
    return likeness(one, other) >= least


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: with_next(table(spark, sf_dir, "documents")))[0]
