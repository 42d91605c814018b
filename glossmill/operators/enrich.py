"""Enrichment of entries by keyed lookups, the last one of each key counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by(lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): for each key the value that comes last."""
    return lookup.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias("_value"))


def overwrite(entries: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Sets a column of all entries whose expression is in lookup(_key, _value); reading and dictionary don't matter."""
    joined = entries.join(lookup, F.col("expression") == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce(F.col("_value"), F.col(column))).drop("_key", "_value")


def fill(entries: DataFrame, lookup: DataFrame, column: str, missing) -> DataFrame:
    """As overwrite(), but only where the column holds the value that stands for a missing one."""
    joined = entries.join(lookup, F.col("expression") == F.col("_key"), "left")
    return joined.withColumn(column, F.when(F.coalesce(F.col(column) == missing, F.lit(True)), F.coalesce(F.col("_value"), F.col(column))).otherwise(F.col(column))).drop("_key", "_value")
