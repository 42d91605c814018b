"""Bookkeeping tables: latest-wins upserts, deletes, renames, and the reads on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.sources.tables import cut

HISTORY_LIMIT, EXPORT_LIMIT, LEAST_QUERY = 20, 50, 2


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Rows of a key are pre-aggregated, so a hot key is no large group."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with the rows put in; a row replaces the one of its key, whatever their ages."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest(both, keys, ["_new", *order]).drop("_new")


def recent(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def without(rows: DataFrame, column: str, value) -> DataFrame:
    """rows but those with the value; null is no value."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(value)))


def rename(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def emptied(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def with_hits(history: DataFrame, found: DataFrame, least: int = LEAST_QUERY) -> DataFrame:
    """Queries worth keeping: long enough, and with results in found(query)."""
    return history.filter(F.length("query") >= least).join(found.select("query").distinct(), "query", "left_semi")


def exported(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(log.select(*keys).distinct(), keys, "left_semi")


def not_exported(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(log.select(*keys).distinct(), keys, "left_anti")


def write_version(df: DataFrame, root: str, partition_by: str | None = None) -> str:
    """Writes a table as a new version below root and returns its path. Readers hold on to the version that they opened."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def read_version(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def numbered(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Adds ids from `first` on, in an order that does not depend on the partitioning.

    Each range partition counts its own rows; a table of one row a partition holds how many come before.
    """
    ranged = cut(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(counts.select("_part", "_before"), "_part").withColumn("id", F.col("_before") + F.col("_own") + (first - 1)).drop("_part", "_own", "_before")
