"""Import of archives into the entry table and the catalog."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import enrich, fulltext, store
from glossmill.sources import archive
from glossmill.sources.tables import cut

ORDER = ["path", "ord", "pos"]


class Imported(NamedTuple):
    """What archives hold: entries without ids, ranks and accents, and a row of the catalog for each archive, with its path."""

    terms: DataFrame
    meta: DataFrame
    listed: DataFrame


def read(members: DataFrame, null_as_text: bool = False) -> Imported:
    """Reads parts of archives, or their members' texts. What cannot be read is left out; archive.errors() tells it.

    The count of an archive that has meta banks only is of the ranks and accents that it sets.
    """
    whole = archive.parsed(members)
    whole = cut(whole.withColumn("text", F.when(F.col("kind") == "index", F.col("text"))))  # an element's text is its variant
    parts = archive.readable(whole, cut(archive.errors(whole)))
    usable = cut(archive.usable_meta(parts))
    terms, meta, index = cut(archive.terms(parts, null_as_text)), cut(archive.meta(usable)), cut(archive.index(parts))
    of_terms = terms.groupBy("path").agg(F.count(F.lit(1)).alias("n")).join(index.filter("not meta_only"), "path", "left_semi")
    counts = of_terms.unionByName(archive.meta_counts(usable).join(index.filter("meta_only"), "path", "left_semi"))
    rows = index.join(counts, "path", "left").select(F.col("title").alias("name"), "version", "revision", F.coalesce("n", F.lit(0)).cast("long").alias("entry_count"), F.lit(True).alias("enabled"), F.lit(0).alias("priority"), "path")
    return Imported(terms, meta, cut(rows))


def new_entries(terms: DataFrame, first: int) -> DataFrame:
    """Entries with ids from `first` on, in the order of files, members and elements."""
    empty = F.lit("")
    return store.numbered(terms, ORDER, first).drop(*ORDER).withColumns({"example_sentence": empty, "example_sentence_translation": empty, "audio_file": empty})


def with_meta(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Entries with the ranks and accents of meta, in all dictionaries."""
    ranks = meta.filter(F.col("type") == "freq").select(F.col("expression").alias("_key"), F.col("frequency").alias("_value"))
    accents = meta.filter(F.col("type") == "pitch").select(F.col("expression").alias("_key"), F.col("pitch").alias("_value"))
    return enrich.overwrite(enrich.overwrite(entries, ranks, "frequency"), accents, "pitch_accent")


def import_archives(members: DataFrame, entries: DataFrame | None = None, catalog: DataFrame | None = None, append: bool = False, null_as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, catalog) with the archives of members() added.

    Dictionaries of the same names are replaced; with `append` their entries stay beside the new ones, and only the catalog
    row is replaced. With `null_as_text` a JSON null for tags is the text "null". Ranks and accents of the archives go to all entries, those that were there before too. New ids follow
    the largest one there is, in the order of files, members and elements.
    """
    got = read(members, null_as_text)
    new = new_entries(got.terms, 1 if entries is None else (entries.agg(F.max("id")).first()[0] or 0) + 1)
    if entries is not None:
        kept = entries if append else entries.join(new.select("dictionary_name").distinct(), "dictionary_name", "left_anti")
        new = kept.select(*new.columns).union(new)
    new = with_meta(new, got.meta)
    if catalog is None:
        return new, store.latest(got.listed, ["name"], ["path"]).drop("path")
    return new, store.upsert(catalog.withColumn("path", F.lit("")), got.listed, ["name"], ["path"]).drop("path")


#: Columns of entries that the full-text index covers.
INDEXED = ("expression", "reading", "definition")


def publish(entries: DataFrame, catalog: DataFrame, root: str) -> dict[str, str]:
    """Writes entries, catalog and the index of just these entries as new versions below root, and returns their paths.

    The index is in the order of tokens, so that a search reads few of its files' row groups. Who reads older versions keeps
    them until their folders are removed.
    """
    paths = {"entries": store.write_version(entries, f"{root}/entries"), "catalog": store.write_version(catalog, f"{root}/catalog")}
    stored = store.read_version(entries.sparkSession, paths["entries"], entries.schema)
    texts = stored if "definition" in stored.columns else stored.withColumn("definition", F.array_join("definitions", "\n"))
    tokens = fulltext.token_table(texts, "id", INDEXED)
    paths["index"] = store.write_version(tokens.repartitionByRange("token").sortWithinPartitions("token"), f"{root}/index")
    return paths


def published(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, catalog, index) of a version."""
    return tuple(store.read_version(spark, paths[name]) for name in ("entries", "catalog", "index"))


def delete_dictionary(spark: SparkSession, paths: dict[str, str], root: str, name: str) -> dict[str, str]:
    """A new version without a dictionary: its entries, its row of the catalog and its part of the index are gone."""
    entries, catalog, _ = published(spark, paths)
    return publish(store.without(entries, "dictionary_name", name), store.without(catalog, "name", name), root)
