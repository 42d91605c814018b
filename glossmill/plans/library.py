"""A library of dictionaries in versions: entries, catalog and index change together or not at all.

Entries are in parts, one an import, each in folders by dictionary. A dictionary that goes is named by the manifest and its
folders are no longer read; nothing is rewritten for it. Ranks and accents of an archive go to entries that are there already,
so an import that has any writes all entries anew; one without writes its own. The index gets a segment or a tombstone.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import enrich, fulltext, postings, search, store
from glossmill.plans import imports
from glossmill.sources import versions
from glossmill.sources.tables import cut

ENTRIES = "id long, expression string, reading string, definitions array<string>, frequency int, pitch_accent string, parts_of_speech string, dictionary_name string, sequence_number int, example_sentence string, example_sentence_translation string, audio_file string"
CATALOG = "name string, version string, revision string, entry_count long, enabled boolean, priority int"
EMPTY: dict = {"version": 0, "entries": [], "catalog": None, "index": postings.EMPTY, "next_id": 1, "changed": [], "operation": "none"}


class Result(NamedTuple):
    """What a change came to; without success nothing has changed, and error says why."""

    success: bool
    version: int
    names: tuple[str, ...] = ()
    entries: int = 0
    error: str | None = None


def _now(spark: SparkSession, root: str, version: int | None = None) -> dict:
    return versions.manifest(spark, root, version) or EMPTY


def _entries(spark: SparkSession, content: dict) -> DataFrame:
    parts = []
    for part in content["entries"]:
        rows = spark.read.schema(f"{ENTRIES}, _of string").parquet(part["path"])
        gone = part["without"]
        if gone:  # the first condition leaves out folders, the second one is what counts
            rows = rows.filter(~F.col("_of").isin([hashlib.md5(g.encode()).hexdigest() for g in gone]) & ~F.col("dictionary_name").isin(gone))
        parts.append(rows.drop("_of"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], ENTRIES)


def _catalog(spark: SparkSession, content: dict) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(content["catalog"]) if content["catalog"] else spark.createDataFrame([], CATALOG)


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The entries of a version, or of the last one."""
    return _entries(spark, _now(spark, root, version))


def catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return _catalog(spark, _now(spark, root, version))


def index(spark: SparkSession, root: str, version: int | None = None) -> dict:
    return _now(spark, root, version)["index"]


def find(spark: SparkSession, root: str, query: str, limit: int = 50, prefix_last: bool = False, version: int | None = None) -> DataFrame:
    """Entries that hold the query, the most frequent first; index and entries are of one version."""
    content = _now(spark, root, version)
    tokens = postings.tokens(spark, content["index"])
    return fulltext.search(_entries(spark, content), tokens, fulltext.match_query(query), [*search.rank_keys(), F.length("expression"), "id"], limit, prefix_last)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("definition", F.array_join("definitions", "\n"))


def _put_entries(rows: DataFrame, root: str) -> dict:
    named = rows.withColumn("_of", F.md5(F.coalesce("dictionary_name", F.lit(""))))
    return {"path": versions.put(named.repartitionByRange("_of", "id"), root, "entries", "_of"), "without": []}


def _changed(spark: SparkSession, root: str, change) -> Result:
    """Runs change(manifest, written) to the next manifest and its Result, and commits it; what was written goes if that fails."""
    before, written = _now(spark, root), []
    try:
        content, result = change(before, written)
        version = versions.commit(spark, root, before["version"], content)
    except (versions.Conflict, PySparkException, Py4JError, OSError, ValueError) as e:
        versions.remove(spark, written)
        return Result(False, before["version"], error=str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__)
    return result._replace(version=version)


def add(spark: SparkSession, root: str, members: DataFrame, append: bool = False, null_as_text: bool = False) -> Result:
    """Imports archives, parts or members of them, as one version. Dictionaries of the same names are replaced, or with `append` kept beside.

    Two imports at a time: the first one to end wins, the other one changes nothing and says so.
    """

    def change(before: dict, written: list[str]) -> tuple[dict, Result]:
        got = imports.read(members, null_as_text)
        new = cut(imports.new_entries(got.terms, before["next_id"]).select(*[c.split()[0] for c in ENTRIES.split(", ")]))
        counted, top = new.agg(F.count(F.lit(1)), F.max("id")).first()
        names = sorted(r[0] for r in got.listed.select("name").distinct().collect())
        of_terms = sorted(r[0] for r in new.select("dictionary_name").distinct().collect())
        seq, old = before["version"] + 1, before["entries"]
        found = before["index"]
        replaced = [] if append else sorted({r[0] for r in _catalog(spark, before).select("name").collect()} & set(of_terms))
        if replaced:
            found = postings.without_rows(found, _entries(spark, before).filter(F.col("dictionary_name").isin(replaced)).select("id"), root, seq)
            written.append(found["tombstones"][-1]["path"])
            old = [p | {"without": sorted({*p["without"], *replaced})} for p in old]
        touched = set(names)
        if got.meta.isEmpty():
            parts = list(old)
            if counted:
                parts.append(_put_entries(new, root))
                written.append(parts[-1]["path"])
        else:
            kept = _entries(spark, before | {"entries": old})
            keys = got.meta.select(F.col("expression").alias("_key")).distinct()
            touched |= {r[0] for r in kept.join(keys, F.col("expression") == F.col("_key"), "left_semi").select("dictionary_name").distinct().collect()}
            parts = [_put_entries(imports.with_meta(kept.unionByName(new), got.meta), root)]
            written.append(parts[0]["path"])
        if counted:
            found = postings.with_rows(found, _texts(new), "id", imports.INDEXED, root, seq)
            written.append(found["segments"][-1]["path"])
        merged = postings.merged(spark, found, root)
        if merged is not found:
            written.append(merged["segments"][0]["path"])
        listed = versions.put(store.upsert(_catalog(spark, before).withColumn("path", F.lit("")), got.listed, ["name"], ["path"]).drop("path"), root, "catalog")
        written.append(listed)
        content = {"entries": parts, "catalog": listed, "index": merged, "next_id": max(before["next_id"], (top or 0) + 1), "changed": sorted(touched), "operation": "import"}
        return content, Result(True, 0, tuple(names), sum(r[0] for r in got.listed.select("entry_count").collect()))

    return _changed(spark, root, change)


def delete(spark: SparkSession, root: str, name: str) -> Result:
    """A version without a dictionary; of the tables only the catalog is written, and the tombstone of its ids."""

    def change(before: dict, written: list[str]) -> tuple[dict, Result]:
        ids = cut(_entries(spark, before).filter(F.col("dictionary_name") == name).select("id"))
        found = postings.without_rows(before["index"], ids, root, before["version"] + 1)
        written.append(found["tombstones"][-1]["path"])
        listed = versions.put(store.without(_catalog(spark, before), "name", name), root, "catalog")
        written.append(listed)
        parts = [p | {"without": sorted({*p["without"], name})} for p in before["entries"]]
        return before | {"entries": parts, "catalog": listed, "index": found, "changed": [name], "operation": "delete"}, Result(True, 0, (name,), ids.count())

    return _changed(spark, root, change)


def tidy(spark: SparkSession, root: str) -> Result:
    """A version of the same rows with one part of entries and one segment of the index."""

    def change(before: dict, written: list[str]) -> tuple[dict, Result]:
        part = _put_entries(_entries(spark, before), root)
        written.append(part["path"])
        found = postings.merged(spark, before["index"], root, 0)
        written.extend(s["path"] for s in found["segments"] if s not in before["index"]["segments"])
        return before | {"entries": [part], "index": found, "changed": [], "operation": "tidy"}, Result(True, 0)

    return _changed(spark, root, change)
