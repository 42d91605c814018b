"""An index of beginnings: expressions and readings as rows of one table in the order of their folded texts.

A search for what begins with a text is a range of that order, so of the index it reads the files, row groups and pages whose
bounds meet the range, however large the rest is. The ranking needs nothing but the index; the entries of the few best are
read by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import ascii_lower
from glossmill.operators.search import COMBINED_LIMIT, begins, rank_keys, ranked
from glossmill.sources.versions import put

INDEX = "key string, text string, col string, id long, frequency int, length int"
#: Rows of a page, the least that is skipped or read.
PAGE = 1000


def beginnings(entries: DataFrame) -> DataFrame:
    """(key, text, col, id, frequency, length): a row for the expression and one for the reading of each entry, where there is one."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in ("expression", "reading")])
    rows = entries.select(F.explode(each).alias("x"), F.col("id").cast("long").alias("id"), F.col("frequency").cast("int").alias("frequency"), F.length("expression").alias("length"))
    return rows.filter("x.text is not null").select(ascii_lower(F.col("x.text")).alias("key"), "x.text", "x.col", "id", "frequency", "length")


def build(entries: DataFrame, root: str) -> dict[str, str]:
    """Writes the index, and the entries in the order of ids, below root; their paths."""
    index = f"{root}/beginnings"
    beginnings(entries).repartitionByRange("key", "id").sortWithinPartitions("key", "id").write.option("parquet.page.row.count.limit", PAGE).parquet(index)
    return {"index": index, "entries": put(entries.repartitionByRange("id").sortWithinPartitions("id"), root, "entries")}


def _after(text: str) -> str | None:
    """The least text that is above all that begin with this one, none if there is no such."""
    for k in range(len(text) - 1, -1, -1):
        code = ord(text[k]) + 1
        if code <= 0x10FFFF:
            return text[:k] + chr(0xE000 if code == 0xD800 else code)
    return None


def _range(key: Column, query: str, wildcards: bool) -> Column:
    """Bounds of the keys that can match: those that begin as the query does before its first wildcard."""
    folded = "".join(c.lower() if c.isascii() else c for c in query)
    fixed = folded[: min((folded.find(c) for c in "%_" if c in folded), default=len(folded))] if wildcards else folded
    after = _after(fixed) if fixed else None
    bounds = (key >= fixed) if fixed else F.lit(True)
    return bounds & (key < after) if after else bounds


def hits(index: DataFrame, query: str, wildcards: bool = True) -> DataFrame:
    """(id, tier, frequency, length): entries that are the query or begin with it, by the best of their two texts."""
    tier = F.when((F.col("col") == "expression") & (F.col("text") == query), 0).when((F.col("col") == "reading") & (F.col("text") == query), 1).otherwise(2)
    found = index.filter(_range(F.col("key"), query, wildcards)).filter((F.col("text") == query) | begins(F.col("text"), query, wildcards))
    return found.groupBy("id").agg(F.min(tier).alias("tier"), F.first("frequency").alias("frequency"), F.first("length").alias("length"))


def best(index: DataFrame, query: str | None, limit: int = COMBINED_LIMIT, wildcards: bool = True) -> DataFrame:
    """(id, rnk): the first entries in the order of search.combined(), from the index alone. A blank query finds nothing."""
    query = (query or "").strip()
    found = hits(index, query, wildcards) if query else hits(index.limit(0), query)
    return ranked(found, [F.col("tier"), *rank_keys(), F.col("length"), F.col("id")], limit).select("id", "rnk")


def combined(spark: SparkSession, paths: dict[str, str], query: str | None, limit: int = COMBINED_LIMIT, wildcards: bool = True) -> DataFrame:
    """search.combined() of what build() has written: at most `limit` ids come to the driver, and entries are read by them."""
    index = spark.read.schema(INDEX).parquet(paths["index"])
    found = [tuple(r) for r in best(index, query, limit, wildcards).collect()]
    places = spark.createDataFrame(found, "_id long, rnk int")
    entries = spark.read.parquet(paths["entries"]).filter(F.col("id").isin([i for i, _ in found]))
    return entries.join(F.broadcast(places), F.col("id") == F.col("_id")).drop("_id")
