"""Near-duplicates by the Jaccard similarity of their shingle sets, exact.

SimHash groups the sets first, by fingerprints of the same shingles. What fingerprints miss is found along the rarest shingles
of each set, its prefix: in a few rounds each set is held against some leaders of them, then every two sets of
different groups that may be similar enough are paired. All links are verified with the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm import simhash
from glossmill.llm.common import cut, drop_table, may_be_among, stored
from glossmill.llm.components import components

#: Words of a shingle, and the least similarity of near-duplicates as a fraction.
SHINGLE = 5
SIMILAR = (4, 5)
SEED = 42
#: Shingles that are counted together, and the most frequent ones that come last in the order of prefixes. Both change
#: the number of candidates only: the prefixes of any one order lose no pair.
CHUNK = 1 << 21
HOT = 1 << 18
#: Characters of texts whose shingles a task holds at once; one text at least.
HELD = 1 << 22
#: Rounds in which sets are held against leaders only, leaders of a shingle in each (the first of them is the set in the middle
#: of most others, the rest are any), and bits in which the fingerprints of a
#: set and its leader may differ (sets at 0.8 differ in 10 on average). These too change the number of candidates only.
ROUNDS, LEADERS, NEAR = 2, 4, 16

_hash = xxhash.xxh64_intdigest
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as ascending 64-bit hashes: one for a shorter text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < size:
        return np.array([_hash(b" ".join(words), SEED)], np.uint64).view(np.int64)
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, SEED, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique((out * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed 64-bit number: a bit is set if it is in over half of their hashes."""
    counts = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(found), CHUNK):
        counts += np.unpackbits(found[at : at + CHUNK].view(np.uint8)).reshape(-1, simhash.BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found)).view(np.int64)[0])


def needed(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """The least number of shingles that a set of n shares with any set that is similar enough."""
    return -(-n * similar[0] // similar[1])


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many sets of a chunk have each shingle, where more than one has it."""

    def counted() -> pd.DataFrame:
        found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({"h": found[n > 1], "n": n[n > 1]})

    held, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(shingles(text))
            size += len(held[-1])
            if size > CHUNK:
                yield counted()
                held, size = [], 0
    yield counted()


def hot_shingles(docs: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in ascending order, and their ranks by frequency, from 1; `most` rows come to the driver."""
    counts = docs.select("text").mapInPandas(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "h").limit(most).toPandas()
    hot, n = found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    at = np.argsort(hot)
    return hot[at], n[at]


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches in batches of HELD characters."""
    for batch in batches:
        upto = batch["text"].str.len().fillna(0).astype("int64").cumsum() // HELD
        for _, part in batch.groupby(upto.to_numpy(), sort=False):
            yield part


def _prefixes(hot: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _held(batches):
            fps, sims, sizes, heads, middles = [], [], [], [], []
            for text in batch["text"]:
                found = shingles(text)
                fps.append(_hash(found.tobytes(), SEED))
                sims.append(fingerprint(found))
                sizes.append(len(found))
                rank = np.zeros(len(found), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                    rank = np.where(hot[at] == found, counts[at], 0)
                first = np.lexsort((found, rank))[: len(found) - needed(len(found)) + 1]
                heads.append(found[first])
                middles.append(int(rank[first].sum()) // max(len(first), 1))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": np.array(fps, np.uint64).view(np.int64), "sim": sims, "size": sizes, "middle": middles, "head": heads})

    return prefixes


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _held(batches):
        yield pd.DataFrame({"fp": batch["fp"], "set": [shingles(t) for t in batch["text"]]})


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """(a, b): the smallest fp of each group of sets of distinct(fp, sim) whose fingerprints SimHash links, with every other one."""
    near = cut(components(simhash.links(distinct.select(F.col("sim").alias("fp")).distinct())))
    grouped = cut(distinct.join(near, F.col("sim") == F.col("node"), "left").select(F.col("fp").alias("b"), F.coalesce("root", "sim").alias("group")))
    least = grouped.groupBy("group").agg(F.min("b").alias("a"))
    return grouped.join(least, "group").filter("a <> b").select("a", "b")


def postings(distinct: DataFrame) -> DataFrame:
    """(h, fp, sim, size, middle, at): the sets of distinct(fp, sim, size, middle, head) at each shingle that more than one prefix holds.

    at is how many of the set's shingles come before h.
    """
    heads = distinct.select("fp", "sim", "size", "middle", F.posexplode("head").alias("at", "h")).repartition("h")  # moved once for both
    common = heads.groupBy("h").count().filter("count > 1").select("h")
    return heads.join(common, "h", "left_semi").select("h", "fp", "sim", "size", "middle", "at")


def _rooted(posted: DataFrame, grouped: DataFrame) -> DataFrame:
    """posted with the root of each set as grouped(fp, root) has it, at the shingles where more than one root is left.

    major is the root that most of a shingle's sets have. A set is left out where so many of its shingles come before the
    shingle that it could not be similar to the smallest set there.
    """
    rooted = posted.join(grouped.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"), "left").select("h", "fp", "sim", "size", "middle", "at", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.repartition("h")  # moved once for all of the following
    roots = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("count"), F.min("size").alias("least")).groupBy("h")
    roots = roots.agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max_by("root", F.struct("count", "root")).alias("major"))
    kept = rooted.join(roots.filter("n > 1").select("h", "least", "major"), "h").filter(_enough("size", "at", "least"))
    return cut(kept.drop("least"))


def _enough(size: str, at: str, other: str) -> Column:
    """Whether a set's shingles from place `at` on are as many as it must share with one of size `other`.

    Where two sets meet first, in the order of prefixes, all that they share comes from there on.
    """
    top, of = SIMILAR
    return (F.col(size) - F.col(at)) * (top + of) >= (F.col(size) + F.col(other)) * top


def led_pairs(rooted: DataFrame, nth: int) -> DataFrame:
    """(a, b): each set b with leaders a of other roots; LEADERS pairs a set at most.

    A shingle has LEADERS leaders, so there are at most as many candidates as LEADERS times the postings, however large the
    groups of near copies are. The first is the set whose prefix is most frequent: among near copies the one that they were
    made from, or the nearest to it. The others are chosen by hashes that differ with nth. Of those that a set meets the ones
    with the nearest fingerprints are taken; of the first ones, in round 0, the most frequent, whatever its fingerprint.
    """
    members = F.struct(F.col("fp").alias("a"), F.col("sim").alias("s"), F.col("size").alias("m"), F.col("at").alias("i"), F.col("middle").alias("w"), F.col("root").alias("ra"))
    chosen = [F.max_by(members, F.struct("middle", F.xxhash64("fp")))]
    chosen += [F.min_by(members, F.xxhash64(F.lit(nth * LEADERS + k), "h", "fp")) for k in range(1, LEADERS)]
    leaders = rooted.groupBy("h").agg(F.array(*chosen).alias("led")).select(F.col("h").alias("_h"), F.posexplode("led").alias("k", "led")).select("_h", "k", "led.*")
    apart = F.bit_count(F.col("sim").bitwiseXOR(F.col("s")))
    by_middle = (F.col("k") == 0) & F.lit(nth == 0)
    may = _enough("m", "i", "n") & _enough("n", "j", "m") & (by_middle | (apart <= NEAR))
    met = rooted.withColumnsRenamed({"size": "n", "at": "j"}).join(leaders, F.col("h") == F.col("_h")).filter((F.col("ra") != F.col("root")) & may)
    nearest = F.min_by("a", F.struct(F.when(by_middle, -F.col("w")).otherwise(apart), F.col("a")))
    return met.groupBy(F.col("fp").alias("b"), "k").agg(nearest.alias("a")).select("a", "b").distinct()


def all_pairs(rooted: DataFrame) -> DataFrame:
    """(a, b): all sets of different roots with a common shingle in their prefixes that may be similar.

    Two similar sets share a shingle of their prefixes: each prefix leaves out fewer shingles than the sets must share. From
    the first one on, each has as many shingles as they must share; a later one that they share need not be met, so sets near
    a large group of copies do not meet it in all that is frequent there. One of
    two sets of different roots is not of the shingle's major root, so only those others are paired with all of its sets,
    and a group of near copies that has become one root is not paired with itself.
    """
    left = rooted.select("h", F.col("fp").alias("x"), F.col("size").alias("m"), F.col("at").alias("i"), F.col("root").alias("rx"), (F.col("root") == F.col("major")).alias("of_major"))
    right = rooted.filter("root <> major").select(F.col("h").alias("_h"), F.col("fp").alias("y"), F.col("size").alias("n"), F.col("at").alias("j"), F.col("root").alias("ry"))
    once = F.col("of_major") | (F.col("x") < F.col("y"))
    may = _enough("m", "i", "n") & _enough("n", "j", "m")
    met = left.join(right, (F.col("h") == F.col("_h")) & (F.col("rx") != F.col("ry")) & once & may)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) of fps of distinct(fp, text_hash), sets of docs, that are similar enough by their whole sets."""
    top, of = SIMILAR
    met = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    keys = cut(distinct.select("fp", F.col("text_hash").alias("_hash")).join(met, "fp", "left_semi"))
    texts = docs.select("text", F.xxhash64("text").alias("text_hash"))
    texts = may_be_among(texts, F.col("text_hash"), keys.select("_hash")).filter("_among")  # other texts are not moved
    texts = texts.join(keys, F.col("text_hash") == F.col("_hash")).groupBy("fp").agg(F.first("text").alias("text"))
    sets, of_sets = stored(texts.mapInPandas(_sets, "fp long, set array<long>"))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    found = cut(both.filter(same * of >= (F.size("x") + F.size("y") - same) * top).select("a", "b"))
    drop_table(docs.sparkSession, of_sets)
    return found


def joined(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """(fp, root): grouped(fp, root) with the groups joined that pairs(a, b) link, as far as they are similar enough."""
    found = verified(docs, distinct, cut(pairs))
    if grouped is not None:
        found = found.union(grouped.select("fp", "root"))
    return cut(components(found).select(F.col("node").alias("fp"), "root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root), one row per input row.

    fp stands for the set of shingles, so copies are one fp and are never paired; null, empty and blank texts have the
    empty set, and so do equal rows. root is the smallest fp that links reach. An empty table gives no rows.
    """
    hashed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = hashed.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would read numbers with nulls as floats
    heads, all_heads = stored(texts.mapInPandas(_prefixes(*hot_shingles(docs)), "doc_id string, text_hash long, fp long, sim long, size long, middle long, head array<long>"))
    rows = cut(heads.select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "fp"))
    firsts = [F.min("text_hash").alias("text_hash"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("middle").alias("middle"), F.first("head").alias("head")]
    prefixed, of_sets = stored(heads.filter("size > 0").groupBy("fp").agg(*firsts))
    drop_table(docs.sparkSession, all_heads)
    distinct, posted = cut(prefixed.select("fp", "text_hash", "sim")), cut(postings(prefixed))
    drop_table(docs.sparkSession, of_sets)
    grouped = joined(docs, distinct, by_fingerprint(distinct))
    for nth in range(ROUNDS):
        grouped = joined(docs, distinct, led_pairs(_rooted(posted, grouped), nth), grouped)
    grouped = joined(docs, distinct, all_pairs(_rooted(posted, grouped)), grouped)
    return rows.join(grouped.withColumnRenamed("fp", "node"), F.col("fp") == F.col("node"), "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))
