"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import drop_table, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node that links reach from it.

    Alternates two steps until the links no longer change: each node hands its smallest neighbour to its larger ones, then
    to its smaller ones. What is left is a star around each root. A round reads and writes a link table of at most the
    first one's size. Minima are pre-aggregated and stored before they are joined back, so that a node with a large part of
    all links is a skewed join that adaptive execution splits. Links with a null end or with equal ends are ignored; an
    empty table gives no rows.
    """
    spark = links.sparkSession
    links = links.filter("a is not null and b is not null and a <> b")
    edges, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, old = now, [path]
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, p = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        old.append(p)
        large, p = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        old.append(p)
        least, p = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        old.append(p)
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges, path = stored(small.distinct())
        for p in old:
            drop_table(spark, p)
