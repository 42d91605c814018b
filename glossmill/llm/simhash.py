"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from glossmill.llm.common import cut, packed, row_hash, settled, table
from glossmill.llm.components import components

BITS = 64
#: Fingerprints that differ in at most so many bits are linked.
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: A partition value that more fingerprints share than this is resolved by neighbourhoods instead of comparisons.
CROWD = 256
#: Cost of a shuffled probe, in comparisons.
PROBE = 20.0


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        spans = zip(starts[at:upto].tolist(), ends[at + min(size, len(words)) - 1 : upto + min(size, len(words)) - 1].tolist(), strict=True)
        hashes = np.array([_hash(joined[i:j], SEED) for i, j in spans], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.int64)[0])


_hash = xxhash.xxh64_intdigest
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each two bits are both set, over a partition's fingerprints."""
    both, rows = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both += bits.T @ bits
        rows += len(bits)
    i, j = np.indices(both.shape)
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": both.ravel().astype(np.int64)})
    yield pd.DataFrame({"i": [-1], "j": [-1], "n": [rows]})


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each two bits the share of rows that have both; at most 4,097 rows come to the driver."""
    both, rows = np.zeros((BITS, BITS)), 0
    for i, j, n in distinct.select("fp").mapInPandas(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            rows = n
        else:
            both[i, j] = n
    return rows, both / max(rows, 1)


def agreement(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two random rows agree in a bit, and in both of two bits."""
    p = np.diag(both)
    one = p**2 + (1 - p) ** 2
    a, b, c = both, p[:, None] - both, p[None, :] - both
    return one, a**2 + b**2 + c**2 + np.clip(1 - a - b - c, 0, 1) ** 2


def group_bits(both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of like size; each group grows from the free bit that is most correlated with it."""
    p = np.diag(both)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    tie = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(free, key=lambda i: (tie[i, sorted(free)].max(), -i))]
        free.remove(group[0])
        while len(group) < size:
            nearest = max(free, key=lambda i: (tie[i, group].max(), -i))
            group.append(nearest)
            free.remove(nearest)
        groups.append(group)
    return groups


def candidate_rate(group: list[int], one: np.ndarray, two: np.ndarray, most: int) -> list[float]:
    """Estimated chance that two random rows differ in at most 0, 1, ... `most` bits of the group.

    Each bit's agreement is conditioned on that of the earlier bit of the group that it depends on most.
    """
    agree = [one[group[0]]]
    for k in range(1, len(group)):
        agree.append(max(two[group[k], j] / one[j] for j in group[:k]))
    odds = [(1 - q) / q for q in agree]
    sums = [1.0] + [0.0] * most
    for o in odds:
        for t in range(most, 0, -1):
            sums[t] += sums[t - 1] * o
    return list(np.minimum(1.0, np.cumsum(sums) * float(np.prod(agree))))


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds -1, 0, 1, ... of the groups with the given sum and the least total cost; -1 (never probed) is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (paid, chosen) in best.items():
            for t in range(-1, len(cost)):
                price = paid + (cost[t] if t >= 0 else 0.0)
                if total + t not in step or price < step[total + t][0]:
                    step[total + t] = (price, [*chosen, t])
        best = step
    return best[budget]


def plan(rows: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of each group to probe.

    For every number of groups, thresholds that sum to distance - groups + 1 lose no pair: were each group's difference
    above its threshold, all differences would sum to more than the distance. The cheapest allocation of all is taken.
    """
    one, two = agreement(both)
    found = None
    for parts in range(2, 9):
        groups = group_bits(both, parts)
        costs = []
        for group in groups:
            rates = candidate_rate(group, one, two, 1)
            balls = [1, 1 + len(group)]
            costs.append([rows * PROBE * ball + rows * rows * rate / 2 for ball, rate in zip(balls, rates, strict=True)])
        price, chosen = allocate(costs, distance - parts + 1)
        if found is None or price < found[0]:
            found = price, [(sum(1 << b for b in group), t) for group, t in zip(groups, chosen, strict=True) if t >= 0]
    return found[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(groups: list[tuple[int, int]], balls: bool) -> Column:
    """(group, value) for the index, or for the probes: all values within the group's threshold."""
    keys = []
    for k, (mask, threshold) in enumerate(groups):
        bits = [b for b in range(BITS) if mask >> b & 1]
        for flips in range(threshold + 1 if balls else 1):
            for chosen in combinations(bits, flips):
                value = F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(sum(1 << b for b in chosen))))
                keys.append(F.struct(F.lit(k).alias("part"), value.alias("value")))
    return F.explode(F.array(*keys))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints of distinct(fp) at most DISTANCE bits apart, or chains of such that connect the same ones.

    Probes meet the index on (group, value) and are verified. Where more than `crowd` fingerprints share a value, they and
    all that probe it are resolved without comparing each two: every one of them goes to itself and to its 64 neighbours at
    one bit. Two fingerprints are within two bits just if they share such a neighbour, and no neighbour has over 65.
    """
    rows, both = bit_statistics(distinct)
    if rows < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    groups = plan(rows, both)
    wide = any(t > 0 for _, t in groups)
    index = distinct.select(F.col("fp").alias("x"), _keys(groups, False).alias("key")).select("x", "key.part", "key.value")
    probes = distinct.select(F.col("fp").alias("p"), _keys(groups, wide).alias("key")).select("p", "key.part", "key.value")
    crowded = cut(index.groupBy("part", "value").count().filter(F.col("count") > crowd).select("part", "value"))
    close = F.bit_count(F.col("p").bitwiseXOR(F.col("x"))) <= DISTANCE
    if not crowded.head(1):
        return probes.join(index, ["part", "value"]).filter((F.col("p") < F.col("x")) & close).select(F.col("p").alias("a"), F.col("x").alias("b"))
    at = ["part", "value"]
    calm = probes.join(crowded, at, "left_anti").join(index.join(crowded, at, "left_anti"), at)
    calm = calm.filter((F.col("p") < F.col("x")) & close).select(F.col("p").alias("a"), F.col("x").alias("b"))
    dense = probes.join(crowded, at, "left_semi").select(F.col("p").alias("fp")).union(index.join(crowded, at, "left_semi").select(F.col("x").alias("fp"))).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    near = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    met = near.groupBy("z").agg(F.collect_set("fp").alias("met")).filter(F.size("met") > 1).select(F.array_min("met").alias("a"), F.explode("met").alias("b"))
    return calm.union(met.filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root), one row per input row.

    Null and empty texts have fingerprint 0, which links like any other; so do equal rows. Copies are one fingerprint and
    are never paired. component_id is the smallest doc_id that links reach, null only where every document of the component
    lacks an id; root is the component's smallest fingerprint. An empty table gives no rows.
    """
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints("text").alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(distinct.select("fp"), crowd)))
    named = cut(roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("least").alias("smallest")))
    linked = roots.join(named, "root").select("node", "root", "smallest")
    of = cut(distinct.join(linked, distinct["fp"] == linked["node"], "left").select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return rows.join(of, F.col("fp") == F.col("_fp")).drop("_fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = settled(spark, lambda: near_duplicates(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs without near-duplicates as groups(docs) finds them: of each root, the row with the smallest id, then text hash, then row hash."""

    def firsts() -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
        return groups(docs).groupBy("root").agg(first).select(F.struct(F.col("first.id").alias("doc_id"), F.col("first.hash").alias("text_hash")).alias("_key"))

    keys, _ = settled(docs.sparkSession, firsts)
    keyed = packed(docs, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")).alias("_key"), row_hash(docs).alias("_hash"))
    kept = keyed.join(keys, "_key", "left_semi")
    return kept.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_hash"))).filter("_nth = 1").select("_row.*")
