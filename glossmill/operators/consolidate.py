"""Consolidation: one record for all entries that share a reading, in the order of their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions.text import contains_kanji, nonblank
from glossmill.operators.search import rank_keys

MAX_INT = 2147483647


def reading_key() -> Column:
    return F.when(nonblank(F.col("reading")), F.col("reading")).otherwise(F.col("expression"))


def _in_order(column: str) -> Column:
    """All values of a column in the order of the ranks."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rnk", F.col(column).alias("x")))), lambda e: e["x"])


def _first(column: str) -> Column:
    """The first nonblank value, or an empty text."""
    return F.coalesce(F.min_by(column, F.when(nonblank(F.col(column)), F.col("rnk"))), F.lit(""))


def consolidate(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Merged records of entries with ranks (rnk), within each value of `by`.

    The primary entry is one with a kanji if there is any, then the most frequent, then the first. Lists hold distinct values
    in the order of their first ranks. first_rank orders the records.
    """
    f = F.when(F.col("frequency") > 0, F.col("frequency")).otherwise(MAX_INT)
    example = F.min_by(F.struct("example_sentence", "example_sentence_translation"), F.when(nonblank(F.col("example_sentence")), F.col("rnk")))
    grouped = rows.groupBy(*by, reading_key().alias("key")).agg(
        F.min_by(F.struct("id", "expression"), F.struct(~contains_kanji(F.col("expression")), f, "rnk")).alias("primary"),
        _in_order("expression").alias("expressions"),
        F.array_distinct(F.filter(F.flatten(_in_order("definitions")), nonblank)).alias("definitions"),
        F.array_distinct(F.filter(_in_order("parts_of_speech"), nonblank)).alias("parts_of_speech"),
        F.coalesce(F.min(F.when(F.col("frequency") > 0, F.col("frequency"))), F.lit(0)).alias("frequency"),
        _first("pitch_accent").alias("pitch_accent"),
        _first("audio_file").alias("audio_file"),
        _first("dictionary_name").alias("dictionary_name"),
        example.alias("example"),
        _in_order("id").alias("entry_ids"),
        F.min("rnk").alias("first_rank"),
    )
    others = F.array_distinct(F.filter("expressions", lambda e: nonblank(e) & (e != F.col("primary.expression"))))
    return grouped.select(
        *by, F.col("primary.id").alias("primary_id"), F.col("primary.expression").alias("primary_expression"), F.col("key").alias("reading"), "definitions", others.alias("alternative_expressions"),
        "frequency", "pitch_accent", "parts_of_speech", "dictionary_name", "entry_ids",
        F.coalesce("example.example_sentence", F.lit("")).alias("example_sentence"), F.coalesce("example.example_sentence_translation", F.lit("")).alias("example_sentence_translation"), "audio_file", "first_rank",
    )


def _values(entries: DataFrame) -> DataFrame:
    """(key, kind, value, at): each distinct expression, definition and part of speech of a reading, and where it comes first.

    Rows are combined before they move, and move by value, so a reading with a large part of all rows is in many tasks.
    """
    order = [F.when(F.col("frequency") > 0, 0).otherwise(1).alias("a"), F.col("frequency").alias("b"), F.col("id").alias("c")]
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(0).alias("nth")))
    listed = F.transform("definitions", lambda d, k: F.struct(F.lit("d").alias("kind"), d.alias("value"), k.alias("nth")))
    each = F.concat(one("e", F.col("expression")), F.coalesce(listed, F.array().cast("array<struct<kind:string,value:string,nth:int>>")), one("p", F.col("parts_of_speech")))
    rows = entries.select(reading_key().alias("key"), F.struct(*order).alias("rank"), F.explode(each).alias("x")).filter(nonblank(F.col("x.value")))
    return rows.groupBy("key", "x.kind", "x.value").agg(F.min(F.struct("rank", "x.nth")).alias("at"))


def consolidate_all(entries: DataFrame, salts: int = 64) -> DataFrame:
    """consolidate() of whole tables: each reading's entries ranked by frequency, then id, and merged; first_rank is 1.

    No window and no list of a reading's rows: single values are minima, lists are gathered from distinct values, and ids in
    `salts` sorted parts of a reading before they meet. What grows with a reading is its result alone.
    """
    rank = F.struct(F.when(F.col("frequency") > 0, 0).otherwise(1), F.col("frequency"), F.col("id"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(nonblank(F.col(c)), rank)), F.lit("")).alias(c)
    f = F.when(F.col("frequency") > 0, F.col("frequency")).otherwise(MAX_INT)
    example = F.min_by(F.struct("example_sentence", "example_sentence_translation"), F.when(nonblank(F.col("example_sentence")), rank))
    single_values = entries.withColumn("key", reading_key()).groupBy("key").agg(
        F.min_by(F.struct("id", "expression"), F.struct(~contains_kanji(F.col("expression")), f, rank)).alias("primary"),
        F.coalesce(F.min(F.when(F.col("frequency") > 0, F.col("frequency"))), F.lit(0)).alias("frequency"),
        *map(first, ("pitch_accent", "audio_file", "dictionary_name")), example.alias("example"),
    )
    of_kind = lambda kind, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "value")))), lambda e: e["value"]).alias(name)
    lists = _values(entries).groupBy("key").agg(of_kind("e", "expressions"), of_kind("d", "definitions"), of_kind("p", "parts_of_speech")).withColumnRenamed("key", "_list_key")
    parts = entries.groupBy(reading_key().alias("_id_key"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("_part")).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "id"))).alias("ids"))
    ids = parts.groupBy("_id_key").agg(F.transform(F.array_sort(F.flatten(F.collect_list("ids"))), lambda e: e["id"]).alias("entry_ids"))
    joined = single_values.join(lists, F.col("key").eqNullSafe(F.col("_list_key")), "left").join(ids, F.col("key").eqNullSafe(F.col("_id_key")))
    none = F.array().cast("array<string>")
    others = F.filter(F.coalesce("expressions", none), lambda e: e != F.col("primary.expression"))
    return joined.select(
        F.col("primary.id").alias("primary_id"), F.col("primary.expression").alias("primary_expression"), F.col("key").alias("reading"), F.coalesce("definitions", none).alias("definitions"), others.alias("alternative_expressions"),
        "frequency", "pitch_accent", F.coalesce("parts_of_speech", none).alias("parts_of_speech"), "dictionary_name", "entry_ids",
        F.coalesce("example.example_sentence", F.lit("")).alias("example_sentence"), F.coalesce("example.example_sentence_translation", F.lit("")).alias("example_sentence_translation"), "audio_file", F.lit(1).alias("first_rank"),
    )


def single(merged: DataFrame) -> DataFrame:
    """Merged records as plain entries, parts of speech in one text."""
    return merged.select(F.col("primary_id").alias("id"), F.col("primary_expression").alias("expression"), "reading", "definitions", "frequency", "pitch_accent", F.array_join("parts_of_speech", ", ").alias("parts_of_speech"), "dictionary_name", "example_sentence", "example_sentence_translation", "audio_file")


def detail(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """For each requested id(id): the merged record, over all entries with its reading, that holds the id.

    The requests find their readings by one join and the entries of those readings by another; ranks come from a window
    within each request's reading.
    """
    asked = ids.select(F.col("id").alias("asked")).distinct()
    keys = entries.join(asked, F.col("id") == F.col("asked")).select("asked", reading_key().alias("wanted"))
    same = entries.join(keys, F.col("reading") == F.col("wanted"))
    same = same.withColumn("rnk", F.row_number().over(Window.partitionBy("asked").orderBy(*rank_keys(), "id")))
    merged = consolidate(same, ("asked",))
    holds = F.array_contains("entry_ids", F.col("asked"))
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.when(holds, 0).otherwise(1), "first_rank"))
    return merged.withColumn("_best", best).filter("_best = 1").drop("_best")
