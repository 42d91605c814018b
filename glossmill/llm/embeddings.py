"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import cut, prefix_sums, settled, table
from glossmill.llm.components import components

COSINE = 0.93
#: Leading principal dimensions that the grid and the boxes use.
GRID = 8
#: Vectors of a block, blocks of a tile, and tiles or intervals that an interval one level up holds.
BLOCK = 512
TILE = 16
FAN = 16
#: Tiles on either side of a comparing task. A block goes to as many tasks as there are groups of so many tiles near it.
SQUARE = 16
#: Tiles times dimensions on a side of a comparing task: wider vectors meet in smaller groups. A task's vectors take 134 MB at most
#: up to 1,024 dimensions, as 2 * 1,024 / dims tiles of 16 * 512 vectors of 8 * dims bytes, and two tiles beyond.
WIDE = 1024
#: Directions beyond GRID that the search for principal ones carries along.
EXTRA = 8
#: Slack of distances, far above rounding: a pair at exactly the threshold is compared, never skipped.
SLACK = 1e-6
LO, HI = [f"lo{k}" for k in range(GRID)], [f"hi{k}" for k in range(GRID)]


def units(vectors: pd.Series) -> np.ndarray:
    x = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(basis: np.ndarray):
    """Sums over a partition: of x (x . b) for each direction b of the basis, of x, and of 1; a row for each number."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((basis.shape[0], basis.shape[1] + 1)), 0
        for batch in batches:
            if len(batch):
                x = units(batch["embedding"])
                total += x.T @ np.column_stack([x @ basis, np.ones(len(x))])
                n += len(x)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": np.append(i.ravel(), -1), "j": np.append(j.ravel(), -1), "s": np.append(total.ravel(), n)})

    return moments


def principal(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Length of most vectors, and directions close to their leading principal ones (length x GRID), from all of them.

    Two steps of subspace iteration from a random basis: what a partition sends grows with the length, not with its square.
    """
    most = distinct.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not most:
        return 0, np.zeros((0, GRID))
    dims = most[0]["dims"]
    vectors = distinct.filter(F.size("embedding") == dims).select("embedding")
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(dims, min(dims, GRID + EXTRA))))[0]
    for last in (False, True):
        sums, n = np.zeros((dims, basis.shape[1] + 1)), 0.0
        for i, j, s in vectors.mapInPandas(_moments(basis), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
            if i < 0:
                n = s
            else:
                sums[i, j] = s
        mean = sums[:, -1] / n
        image = sums[:, :-1] / n - np.outer(mean, mean @ basis)
        if not last:
            basis = np.linalg.qr(image)[0]
    inner = basis.T @ image
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    leading = basis @ turns[:, np.argsort(-values, kind="stable")[:GRID]]
    return dims, np.pad(leading, ((0, 0), (0, GRID - leading.shape[1])))


def _grid(dims: int, directions: np.ndarray, side: float):
    """Adds the vector's grid cell and its place along each grid dimension. Any orthonormal directions shorten distances."""

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["embedding"].map(len)):
                w = directions if length == dims else np.eye(length, GRID)
                x = units(part["embedding"])
                at = x @ w
                yield pd.DataFrame({"label": part["label"], "dims": length, "cell": list(np.floor(at / side).astype(np.int32)), "at": list(at), "k1": part["k1"], "k2": part["k2"], "n": part["n"], "unit": [v.tobytes() for v in x]})

    return grid


def _blocks(most: int):
    """Consecutive vectors of one label and length in blocks of `most` at most, with the box around their places."""

    def block(rows: list[pd.DataFrame], nth: int) -> pd.DataFrame:
        b = pd.concat(rows, ignore_index=True)
        at = np.vstack(b["at"])
        box = dict(zip(LO, at.min(0), strict=True)) | dict(zip(HI, at.max(0), strict=True))
        return pd.DataFrame([{"label": b["label"].iloc[0], "dims": b["dims"].iloc[0], "part": b["_part"].iloc[0], "nth": nth, **box, "k1": b["k1"].tolist(), "k2": b["k2"].tolist(), "n": b["n"].tolist(), "units": b"".join(b["unit"])}])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = nth = 0
        for batch in batches:
            if not len(batch):
                continue
            for _, run in batch.groupby(((batch["label"] != batch["label"].shift()) | (batch["dims"] != batch["dims"].shift())).cumsum()):
                if held and (held[0]["label"].iloc[0], held[0]["dims"].iloc[0]) != (run["label"].iloc[0], run["dims"].iloc[0]):
                    yield block(held, nth)
                    held, size, nth = [], 0, nth + 1
                at = 0
                while at < len(run):
                    take = run.iloc[at : at + most - size]
                    held.append(take)
                    at, size = at + len(take), size + len(take)
                    if size == most:
                        yield block(held, nth)
                        held, size, nth = [], 0, nth + 1
        if held:
            yield block(held, nth)

    return blocks


def _apart(a: str, b: str, reach: float):
    """Whether two boxes are within reach."""
    gap = F.lit(0.0)
    for lo, hi in zip(LO, HI, strict=True):
        g = F.greatest(F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.lit(0.0))
        gap = gap + g * g
    return gap <= reach * reach


def tile_pairs(boxes: DataFrame, tiles: int, reach: float, fan: int = FAN) -> DataFrame:
    """(label, dims, i, j), i <= j: tiles whose boxes are within reach.

    boxes(label, dims, tile, lo.., hi..) stand in grid order. The join begins with one interval of all tiles of a label; each
    pair of intervals that is not provably apart is joined by its parts, down to tiles.
    """
    span = 1
    while span < tiles:
        span *= fan
    pairs = boxes.select("label", "dims").distinct().withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    while True:
        upper = span
        span = max(1, span // fan)
        corners = [F.min(c).alias(c) for c in LO] + [F.max(c).alias(c) for c in HI]
        part = cut(boxes.groupBy("label", "dims", F.floor(F.col("tile") / span).alias("id")).agg(*corners).withColumn("up", F.floor(F.col("id") * span / upper)))
        a, b, p = part.alias("a"), part.alias("b"), pairs.alias("p")
        same = lambda x: (F.col("p.label") == F.col(f"{x}.label")) & (F.col("p.dims") == F.col(f"{x}.dims"))
        met = p.join(a, same("a") & (F.col("p.i") == F.col("a.up"))).join(b, same("b") & (F.col("p.j") == F.col("b.up")))
        met = met.filter((F.col("a.id") <= F.col("b.id")) & _apart("a", "b", reach))
        pairs = cut(met.select("p.label", "p.dims", F.col("a.id").alias("i"), F.col("b.id").alias("j")))
        if span == 1:
            return pairs


def _forest(links: np.ndarray) -> np.ndarray:
    """Smallest number reachable in a bipartite link matrix: rows are 0 .. n-1, columns n .. n+m-1."""
    n, m = links.shape
    root = np.arange(n + m)
    while True:
        rows = np.minimum(root[:n], np.where(links, root[None, n:], n + m).min(1))
        cols = np.minimum(root[n:], np.where(links, rows[:, None], n + m).min(0))
        new = np.concatenate([rows, cols])
        if (new == root).all():
            return root
        root = new


def _compare(cosine: float, reach: float, block: int, square: int):
    """Links between two groups of tiles, or within one: (node, null, linked vectors) and the links (node, root, null) of a forest."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["gi"].iloc[0]), int(rows["gj"].iloc[0])
        rows = rows.sort_values("seq", ignore_index=True)
        width = int(rows["dims"].iloc[0])
        group = (rows["tile"] // square_of(width, square)).to_numpy()
        vectors = [np.frombuffer(u, np.float64).reshape(-1, width) for u in rows["units"]]
        times = [np.asarray(n, np.int64) for n in rows["n"]]
        lo, hi = rows[LO].to_numpy(), rows[HI].to_numpy()
        starts = np.cumsum([0, *map(len, vectors)])
        nodes = np.concatenate([s * block + np.arange(len(v)) for s, v in zip(rows["seq"], vectors, strict=True)])
        linked, parent = np.zeros(starts[-1], np.int64), list(range(starts[-1]))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in np.flatnonzero(group == i).tolist():
            gaps = np.maximum(0.0, np.maximum(lo[a] - hi, lo - hi[a]))
            near = ((gaps**2).sum(1) <= reach * reach) & (group == j)
            if i == j:
                near[:a] = False
            for b in np.flatnonzero(near).tolist():
                links = vectors[a] @ vectors[b].T >= cosine
                if a == b:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                linked[starts[a] : starts[a + 1]] += links @ times[b]
                if a != b:
                    linked[starts[b] : starts[b + 1]] += links.T @ times[a]
                some, other = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
                root = _forest(links[np.ix_(some, other)])
                at = np.concatenate([starts[a] + some, starts[b] + other])
                for x, r in zip(at.tolist(), at[root].tolist(), strict=True):
                    x, r = find(x), find(r)
                    if x != r:
                        parent[max(x, r)] = min(x, r)
        roots = np.array([find(x) for x in range(len(parent))], dtype=np.int64)
        hit, low = np.flatnonzero(linked), np.flatnonzero(roots != np.arange(len(roots)))
        counts = pd.DataFrame({"a": nodes[hit], "b": pd.array([None] * len(hit), dtype="Int64"), "n": pd.array(linked[hit], dtype="Int64")})
        forest = pd.DataFrame({"a": nodes[low], "b": pd.array(nodes[roots[low]], dtype="Int64"), "n": pd.array([None] * len(low), dtype="Int64")})
        return pd.concat([counts, forest], ignore_index=True)

    return compare


def square_of(dims: int, square: int = SQUARE) -> int:
    """Tiles on a side of a comparing task for vectors of so many dimensions."""
    return max(1, min(square, WIDE // max(dims, 1)))


def moves(pairs: DataFrame, square: int = SQUARE) -> DataFrame:
    """(label, dims, gi, gj, tile): the tiles that each comparing task needs.

    Pairs of tiles are dealt to tasks by the groups of square_of() tiles that their two sides are in, so a tile goes to a task once
    for all its partners there. Pairs that are not in `pairs` are apart, and the boxes of their blocks tell it again.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(square), F.floor(F.lit(WIDE) / F.greatest("dims", F.lit(1)))))
    groups = pairs.select("label", "dims", F.floor(F.col("i") / size).alias("gi"), F.floor(F.col("j") / size).alias("gj"), F.explode(F.array("i", "j")).alias("tile"))
    return groups.distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, tile: int = TILE, fan: int = FAN, square: int = SQUARE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors(vec_id, embedding, label).

    Vectors are compared where labels and lengths are equal. A vector that is null, empty or zero, or holds a null or
    non-finite component, or has a null label, links with nothing. Equal vectors of a label are collapsed before the join and
    count as linked to each other, equal rows too. component_id is the smallest id that links reach. A null id stands for
    itself and names no component. An empty table gives no rows.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    own = F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "label", "embedding")
    rows = cut(vectors.select("vec_id", F.when(valid, own[0]).alias("k1"), F.when(valid, own[1]).alias("k2")))
    usable = vectors.filter(valid).select("vec_id", F.col("label").cast("string").alias("label"), "embedding", own[0].alias("k1"), own[1].alias("k2"))
    distinct = cut(usable.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")))
    dims, directions = principal(distinct)
    reach = sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    kinds = "label string, dims int, cell array<int>, at array<double>, k1 long, k2 long, n long, unit binary"
    placed = distinct.select("label", "embedding", "k1", "k2", "n").mapInPandas(_grid(dims, directions, reach), kinds)
    order = ["label", "dims", "cell", "at", "k1", "k2"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    box = ", ".join(f"{c} double" for c in LO + HI)
    blocks = cut(ordered.mapInPandas(_blocks(block), f"label string, dims int, part int, nth int, {box}, k1 array<long>, k2 array<long>, n array<long>, units binary"))
    heads = blocks.select("label", "dims", "part", "nth", *LO, *HI).withColumn("_one", F.lit(1))
    heads = prefix_sums(prefix_sums(heads, [], ["label", "dims", "part", "nth"], "_one", "seq"), ["label", "dims"], ["part", "nth"], "_one", "within")
    heads = cut(heads.withColumn("tile", F.floor((F.col("within") - 1) / tile)).drop("_one", "within"))
    most = heads.agg(F.max("tile")).first()[0]
    pairs = tile_pairs(heads, (most or 0) + 1, reach, fan)
    numbered = blocks.join(heads.select("part", "nth", "seq", "tile"), ["part", "nth"])
    work = moves(pairs, square).join(numbered.select("label", "dims", "tile", "seq", *LO, *HI, "n", "units"), ["label", "dims", "tile"])
    found = cut(work.groupBy("label", "dims", "gi", "gj").applyInPandas(_compare(cosine, reach, block, square), "a long, b long, n long"))
    roots = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    nodes = numbered.select("seq", F.posexplode(F.arrays_zip("k1", "k2"))).select((F.col("seq") * block + F.col("pos")).alias("node"), "col.k1", "col.k2")
    nodes = cut(nodes.join(distinct.select("k1", "k2", F.col("n"), "least"), ["k1", "k2"]))
    rooted = nodes.join(roots, "node").select("node", "root", "least")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("smallest")))
    known = nodes.join(counts, nodes["node"] == counts["a"], "left").join(roots.join(named, "root"), "node", "left")
    known = cut(known.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")))
    joined = rows.join(known, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.when(F.col("_k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: near_duplicates(table(spark, sf_dir, "embeddings")))[0]
