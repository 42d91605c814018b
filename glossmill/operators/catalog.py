"""The catalog of dictionaries that can be had, and which of them are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.containment import containing, touching
from glossmill.sources.tables import cut

# Id, name, category and size of the known dictionaries.
KNOWN = (
    ("jmdict_english", "JMdict (English)", "DICTIONARY", "~15 MB"),
    ("jmdict_forms", "JMdict Forms", "DICTIONARY", "~6 MB"),
    ("jmnedict", "JMnedict (Names)", "DICTIONARY", "~12 MB"),
    ("kanjidic", "KANJIDIC", "KANJI", "~1 MB"),
    ("jpdb_freq", "JPDB Frequency v2.2", "FREQUENCY", "~3 MB"),
    ("kanjium_pitch", "Kanjium Pitch Accent", "PITCH_ACCENT", "~1 MB"),
)


def known(spark: SparkSession, category: str | None = None) -> DataFrame:
    items = spark.createDataFrame(KNOWN, "id string, name string, category string, file_size string")
    return items if category is None else of_category(items, category)


def by_priority(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("priority"), "id")


def by_name(catalog: DataFrame, name: str) -> DataFrame:
    """The dictionary of that name, the first by id if there are several."""
    return catalog.filter(F.col("name") == name).orderBy("id").limit(1)


def squeezed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ _-]", "")


def installed(items: DataFrame, there: DataFrame) -> DataFrame:
    """Items of which a dictionary in there(name) has the same name, part of it, or the id in its name or the other way round.

    Names are compared without case, blanks and dashes. Items and names meet by parts of their texts, so both may be many.
    """
    names = there.select(squeezed(F.col("name")).alias("text"))
    forms = items.withColumns({"_name": squeezed(F.col("name")), "_id": F.regexp_replace(F.lower("id"), "_", "")})
    found = cut(touching(forms.select(F.col("_name").alias("text")).union(forms.select("_id")), names))
    return _with_either(forms, found, found).drop("_name", "_id")


def installed_simple(items: DataFrame, there: DataFrame) -> DataFrame:
    """As installed(), by lower-cased names alone, and by the id with spaces for underscores within a name."""
    names = there.select(F.lower("name").alias("text"))
    forms = items.withColumns({"_name": F.lower("name"), "_id": F.replace(F.col("id"), F.lit("_"), F.lit(" "))})
    by_id = containing(names, forms.select(F.col("_id").alias("text"))).select(F.col("needle").alias("text")).distinct()
    return _with_either(forms, touching(forms.select(F.col("_name").alias("text")), names), by_id).drop("_name", "_id")


def _with_either(forms: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of forms whose _name is in names(text) or whose _id is in ids(text), both of distinct texts."""
    marked = forms.join(names.select(F.col("text").alias("_of_name")), F.col("_name") == F.col("_of_name"), "left").join(ids.select(F.col("text").alias("_of_id")), F.col("_id") == F.col("_of_id"), "left")
    return marked.filter("_of_name is not null or _of_id is not null").drop("_of_name", "_of_id")


def of_category(items: DataFrame, category: str) -> DataFrame:
    return items.filter(F.col("category") == category)


def changed(catalog: DataFrame, id_: int, **values) -> DataFrame:
    """The catalog with columns of the dictionary of that id set."""
    return catalog.withColumns({c: F.when(F.col("id") == id_, F.lit(v).cast(catalog.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


__all__ = ["KNOWN", "by_name", "by_priority", "changed", "installed", "installed_simple", "known", "of_category", "squeezed"]
