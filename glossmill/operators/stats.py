"""Counts over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, all counted in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = reduce(DataFrame.union, counts)
    return rows.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def per_value(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def any_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
