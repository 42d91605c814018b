"""Pieces that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.sources.tables import cut, drop_table, exists, new_path, settled, stored

__all__ = ["BLANKS", "BLANK_RUN", "PLACES", "crc_mod", "cut", "drop_table", "exists", "may_be_among", "new_path", "packed", "prefix_sums", "row_hash", "salted_semi", "settled", "stored", "table", "word_count", "words_of"]

#: The six characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Bits of a bitmap of keys: 262,144 longs at most, whatever the table.
PLACES = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def packed(docs: DataFrame, *keys: Column) -> DataFrame:
    """docs with each row in one column, _row, beside the keys: names of the rows' columns then clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys)


def row_hash(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row; maps and variants are hashed as JSON."""
    hashable = [F.to_json(f"`{f.name}`") if any(t in f.dataType.simpleString() for t in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(F.lit(seed), *hashable)


def crc_mod(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`; null ids count as -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(-1)).cast("int")


def prefix_sums(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `by` up to this one in `order` (nulls last in `by`).

    Rows are range-partitioned, so a key with a third of all rows is spread over many tasks: each partition sums its own
    rows, and a table of one row a partition and key holds what comes before.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    parts = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part", *by).agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], "_start")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    summed = parts.withColumn("_own", F.sum(value).over(own))
    return summed.join(starts, same).withColumn(out, F.col("_start") + F.col("_own")).drop("_part", "_p", "_start", "_own", *[f"_b_{c}" for c in by])


def salted_semi(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """rows whose `on` is in keys, with each key dealt to `salts` places by a hash of `spread`, so that no task gets all rows of a hot one."""
    places = keys.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts))).join(places, [*on, "_salt"], "left_semi").drop("_salt")


def may_be_among(rows: DataFrame, key: Column, keys: DataFrame, places: int = PLACES) -> DataFrame:
    """rows with _among: false only where `key`, a long, is none of the values of the first column of keys.

    The keys' places in a bitmap of `places` bits go to every task, so rows that no join would keep need not be shuffled for
    one. More keys than places make it pass more, and a join after it stays exact. A null key is among none.
    """
    place = lambda c: F.pmod(c, F.lit(places))
    of_keys = keys.select(place(F.col(keys.columns[0])).alias("_at")).filter("_at is not null")
    bits = of_keys.groupBy(F.expr("_at div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    found = rows.withColumn("_at", place(key)).join(F.broadcast(bits), F.expr("_at div 64") == F.col("_word"), "left")
    hit = F.expr("shiftright(_bits, cast(_at % 64 as int)) & 1") == 1
    return found.withColumn("_among", F.coalesce(hit, F.lit(False))).drop("_at", "_word", "_bits")
