"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting: shuffle files of a query go at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's settings: bytes up to which a table is broadcast, by a guess from its files and by what a shuffle has measured.
GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes of files up to which the guess counts. Rows take many times their files where texts repeat, and the driver holds what is broadcast.
MOST_GUESSED = 256 << 10
#: Spark's setting: bytes of rows that a Python task is handed at once, and the most of them that stored() lets it be. Four
#: tasks of an executor hold them as Arrow and as Python's objects beside each other.
HANDED, MOST_HANDED = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; makes one only in local mode, where all tasks share the machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", "")
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="glossmill-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, computed once, and the table's path for drop_table().

    What was shuffled for it goes from the executors' disks once it is written, not only when the driver's memory is collected.
    Tables of files of more than MOST_GUESSED bytes are broadcast only if a shuffle has measured that they are small. Python
    tasks are handed MOST_HANDED bytes at once, a row at least.
    """
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    path, most = new_path(spark), conf.autoBroadcastJoinThreshold()
    settings = {SHUFFLE_CLEANUP: "true", GUESSED: str(min(most, MOST_GUESSED)), MEASURED: spark.conf.get(MEASURED, None) or str(most), HANDED: str(min(conf.arrowMaxBytesPerBatch(), MOST_HANDED))}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor takes nothing of it along."""
    return stored(df)[0]


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What build() gives, stored; the tables that were stored on the way to it go, as nothing reads them any more."""
    on_the_way: list[str] = []
    token = _made.set(on_the_way)
    try:
        df = build()
    finally:
        _made.reset(token)
    found = stored(df)  # listed with an outer settled(), if there is one
    for path in on_the_way:
        drop_table(spark, path)
    return found


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table that someone else writes; goes with the others where settled() clears up."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
