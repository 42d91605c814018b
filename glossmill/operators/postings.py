"""An inverted index that follows single changes: posting lists in segments, tombstones, and a merge.

A segment is a table (token, col, id, positions) in the order of tokens, written once. Rows that come later are a segment of
their own; rows that go leave a table of their ids, a tombstone, which counts for the segments made before it. A search reads
of each segment what holds its tokens, and leaves out what a later tombstone has. A merge makes one segment of all and ends the
tombstones. What an index is made of is a plain description, which a manifest can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.fulltext import token_table
from glossmill.sources.versions import put

SEGMENT = "token string, col string, id long, positions array<int>"
TOMBSTONE = "id long"
#: Segments and tombstones that a search reads before they are merged.
SEGMENTS = 8

EMPTY: dict = {"segments": [], "tombstones": []}


def postings(rows: DataFrame, id_: str, columns: tuple[str, ...]) -> DataFrame:
    """(token, col, id, positions): where each token stands in each column of each row."""
    return token_table(rows, id_, columns).groupBy("token", "col", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("token", "col", F.col("id").cast("long").alias("id"), "positions")


def _ordered(rows: DataFrame) -> DataFrame:
    """In the order of tokens, ids within: a token with many rows is in several files, and a search reads just these."""
    return rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id", "col")


def with_rows(index: dict, rows: DataFrame, id_: str, columns: tuple[str, ...], root: str, seq: int) -> dict:
    """The index with rows put in, as a segment of number seq; numbers rise from change to change."""
    path = put(_ordered(postings(rows, id_, columns)), root, "segment")
    return index | {"segments": [*index["segments"], {"path": path, "seq": seq}]}


def without_rows(index: dict, ids: DataFrame, root: str, seq: int) -> dict:
    """The index without ids(id), as far as they are in segments of numbers below seq."""
    path = put(ids.select(F.col("id").cast("long").alias("id")).distinct(), root, "tombstone")
    return index | {"tombstones": [*index["tombstones"], {"path": path, "seq": seq}]}


def live(spark: SparkSession, index: dict) -> DataFrame:
    """The posting lists that count, with the number of their segment. Filters on the token reach the segments' scans."""
    empty = spark.createDataFrame([], f"{SEGMENT}, seq long")
    segments = [spark.read.schema(SEGMENT).parquet(s["path"]).withColumn("seq", F.lit(s["seq"]).cast("long")) for s in index["segments"]]
    rows = reduce(DataFrame.union, segments) if segments else empty
    if not index["tombstones"]:
        return rows
    dead = reduce(DataFrame.union, [spark.read.schema(TOMBSTONE).parquet(t["path"]).withColumn("_seq", F.lit(t["seq"]).cast("long")) for t in index["tombstones"]])
    dead = dead.groupBy(F.col("id").alias("_id")).agg(F.max("_seq").alias("_seq"))
    return rows.join(dead, F.col("id") == F.col("_id"), "left").filter("_seq is null or seq >= _seq").drop("_id", "_seq")


def tokens(spark: SparkSession, index: dict) -> DataFrame:
    """(id, col, pos, token), as fulltext.match() takes them."""
    return live(spark, index).select("id", "col", F.explode("positions").alias("pos"), "token")


def merged(spark: SparkSession, index: dict, root: str, most: int = SEGMENTS) -> dict:
    """The index as one segment without tombstones where it has more than `most` of them; older versions keep theirs."""
    if len(index["segments"]) + len(index["tombstones"]) <= most:
        return index
    seq = max([s["seq"] for s in index["segments"]] + [t["seq"] for t in index["tombstones"]], default=0)
    path = put(_ordered(live(spark, index).select("token", "col", "id", "positions")), root, "segment")
    return {"segments": [{"path": path, "seq": seq}], "tombstones": []}
