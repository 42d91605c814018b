"""Versions of a set of tables: one small manifest each, which appears as a whole or not at all.

Tables are written to folders of their own first. A manifest then names what makes up the next version, and is put in place by
a rename that fails where that version is there already, so of two writers one wins and the other one sees it. Who reads a
version goes on reading it while newer ones are made.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(version: int) -> str:
    return f"v-{version:020d}.json"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version, 0 where there is none."""
    where, fs = _path(spark, f"{root}/manifests")
    if not fs.exists(where):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return max((int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json")), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version, or else the last one, is made of; nothing where there is none."""
    version = latest(spark, root) if version is None else version
    if not version:
        return {}
    where, fs = _path(spark, f"{root}/manifests/{_name(version)}")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, base: int, content: dict) -> int:
    """Makes content the version after base and returns its number; Conflict where it is there already."""
    version = base + 1
    folder, fs = _path(spark, f"{root}/manifests")
    fs.mkdirs(folder)
    aside, _ = _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    place, _ = _path(spark, f"{root}/manifests/{_name(version)}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(content | {"version": version}, ensure_ascii=False, sort_keys=True).encode() + b"\n"))
    finally:
        stream.close()
    try:
        if fs.exists(place):
            raise Conflict(f"version {version} is there already")
        if fs.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), place.toUri().getPath())  # fails where the name is taken, unlike a local rename
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, place, none)
    except FileExistsError as e:
        raise Conflict(f"version {version} is there already") from e
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"version {version} is there already") from e
        raise
    finally:
        fs.delete(aside, False)
    return version


def put(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> str:
    """Writes a table to a new folder below root and returns its path; no version has it before a manifest says so."""
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where, fs = _path(spark, path)
        fs.delete(where, True)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all manifests but the last `keep`, and the tables that none of those names; the removed tables' paths."""
    last = latest(spark, root)
    kept = [manifest(spark, root, v) for v in range(max(1, last - keep + 1), last + 1)]
    named = json.dumps(kept)
    where, fs = _path(spark, f"{root}/tables")
    gone = [p for p in (f"{root}/tables/{s.getPath().getName()}" for s in (fs.listStatus(where) if fs.exists(where) else [])) if os.path.basename(p) not in named]
    folder, _ = _path(spark, f"{root}/manifests")
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("v-") and int(name[2:-5]) <= last - keep:
            fs.delete(status.getPath(), False)
    remove(spark, gone)
    return gone
