"""Live results: sessions that close by themselves, queries that supersede each other, and tables of the latest results.

Keyed state is held by Spark's state store. Timers run by processing time: a user who has been quiet for a while is done, with
or without later input. A clock beside the input keeps batches coming, so that timers run on after a restart too.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from glossmill.sources import versions
from glossmill.sources.tables import cut

#: Seconds between two inputs of one session, by their own times, and seconds of silence after which a session is over.
GAP, QUIET = 30 * 60, 3
#: Parts of a table of latest results that are read before they are merged.
PARTS = 16

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_clock(events: DataFrame) -> DataFrame:
    """events beside a source that always has something new, none of which comes out."""
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().filter("value < 0")
    return events.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]))


class _Input(StatefulProcessor):
    """The last input of a user, which a timer tells once no other one has come for a while.

    Each call to the state store is a message to another process, so all that is kept is one value: the input, and when its
    timer is due. A timer that expires at another time is one of an earlier input and tells nothing.
    """

    def __init__(self, schema: StructType, quiet: float):
        self.schema, self.names, self.quiet = schema, schema.fieldNames(), quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", StructType([*self.schema.fields[1:], StructField("_due", LongType())]))

    def known(self) -> tuple[tuple | None, int]:
        """What is kept of the user, and when its timer is due."""
        kept = self.pending.get()
        return (None, 0) if kept is None else (tuple(kept[:-1]), kept[-1])

    def rows(self, batch: pd.DataFrame) -> list[tuple]:
        """(at, tie, value) of each row."""
        return [tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in row) for row in batch[self.names[1:]].itertuples(index=False, name=None)]

    def told(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def keep(self, row: tuple, before: int, timer_values) -> None:
        """Keeps row, with a timer of its own in place of the one that was due at `before`."""
        now = timer_values.getCurrentProcessingTimeInMs()
        if before > now:
            self.handle.deleteTimer(before)
        due = now + int(self.quiet * 1000)
        self.pending.update((*row, due))
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class _Debounce(_Input):
    def __init__(self, schema: StructType, quiet: float, gap: float):
        super().__init__(schema, quiet)
        self.gap = int(gap * 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, due = self.known()
        found = sorted([*([kept] if kept else []), *(r for batch in rows for r in self.rows(batch))], key=lambda r: r[:2])
        self.keep(found[-1], due, timerValues)
        yield from self.told(key, [r for r, after in zip(found, found[1:], strict=False) if after[0] - r[0] >= self.gap])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, due = self.known()
        if kept and due == expiredTimerInfo.getExpiryTimeInMs():
            self.pending.clear()
            yield from self.told(key, [kept])


class _Latest(_Input):
    """What was told stays, to be compared with what comes later."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.names[1]
        last = [r for batch in rows for r in self.rows(batch[batch[at] == batch[at].max()])]
        newest = sorted(last, key=lambda r: r[:2])[-1]
        kept, due = self.known()
        if kept is None or newest[:2] > kept[:2]:
            self.keep(newest, due, timerValues)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, due = self.known()
        if kept and due == expiredTimerInfo.getExpiryTimeInMs():
            yield from self.told(key, [kept])


def _processed(events: DataFrame, columns: tuple[str, str, str, str], processor: Callable[[StructType], StatefulProcessor]) -> DataFrame:
    user, at, tie, value = columns
    kinds = {f.name: f.dataType for f in events.schema}
    schema = StructType([StructField(user, kinds[user]), StructField(at, LongType()), StructField(tie, kinds[tie]), StructField(value, kinds[value])])
    timed = with_clock(events.select(user, F.unix_micros(F.col(at).cast("timestamp")).alias(at), tie, value).filter(f"`{at}` is not null"))
    out = timed.groupBy(user).transformWithStateInPandas(processor(schema), schema, "append", "processingTime")
    return out.withColumn(at, F.timestamp_micros(at))


def debounce(events: DataFrame, user: str, at: str, tie: str, value: str, gap: float = GAP, quiet: float = QUIET) -> DataFrame:
    """The last input of each session of a stream of events.

    A session ends where the next input is `gap` seconds later by the inputs' own times, or where none has come for `quiet`
    seconds of real time, so a user's last session comes out without later input. Inputs of one user have to come in order from batch
    to batch; within a batch they are put in order. Null users are one user, inputs without a time are left out.
    """
    return _processed(events, (user, at, tie, value), lambda schema: _Debounce(schema, quiet, gap))


def latest(events: DataFrame, user: str, at: str, tie: str, value: str, quiet: float = QUIET) -> DataFrame:
    """Each user's latest input, once nothing newer has come for `quiet` seconds of real time.

    A newer input takes the place of one that waits, in whatever batch it comes, and one that is older than what was told or
    waits is dropped; so at the end the last row told of each user is the latest of all, however the input is cut into
    batches.
    """
    return _processed(events, (user, at, tie, value), lambda schema: _Latest(schema, quiet))


def start(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a stream with keyed state, into Parquet below root or into each(batch, number); offsets and state are below root."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)  # the query keeps the settings that it is started with
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(processingTime="0 seconds")
        return (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{root}/out").outputMode("append")).start()
    finally:
        spark.conf.set(STORE[0], before)


def run_until_quiet(query: StreamingQuery, quiet: float = QUIET, most: float = 600) -> None:
    """Lets a stream run until its input is read and `quiet` seconds have passed for it, and stops it; raises what it failed with."""
    began, last = time.time(), None
    seen = -1
    try:
        while time.time() - began < most:
            if not query.isActive:
                break
            for progress in query.recentProgress:
                if progress["batchId"] > seen or last is None:
                    seen = max(seen, progress["batchId"])
                    at = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()
                    read = any(s["numInputRows"] for s in progress["sources"] if "RateStream" not in s["description"])
                    if read or last is None:
                        last = at + progress["batchDuration"] / 1000
                    elif at >= last + quiet:
                        return
            time.sleep(0.2)
        else:
            raise TimeoutError(f"the stream had input for {most} seconds")
    finally:
        failed = query.exception()
        query.stop()
        if failed:
            raise failed


# A table of the latest results


def put_batch(batch: DataFrame, number: int, root: str, keys: list[str], order: list[str]) -> int:
    """Puts the results of micro-batch `number` of a stream into the table of the latest results, and returns its version.

    A batch that comes again, after a restart, changes nothing. Of a key's rows the last one in the given order counts,
    whatever batch it came with. A batch is written as it is; when there are many, they are merged to a row a key.
    """
    spark = batch.sparkSession
    now = versions.manifest(spark, root) or {"version": 0, "parts": [], "batch": -1}
    if number <= now["batch"]:
        return now["version"]
    parts = [*now["parts"], versions.put(_last(batch, keys, order), root, "results")]
    if len(parts) > PARTS:
        parts = [versions.put(_last(spark.read.schema(batch.schema).parquet(*parts), keys, order), root, "results")]
    return versions.commit(spark, root, now["version"], {"parts": parts, "batch": number})


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def results(spark: SparkSession, root: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """The latest result of each key, as whoever comes later finds it; no rows before the first batch."""
    parts = versions.manifest(spark, root).get("parts", [])
    return _last(spark.read.schema(schema).parquet(*parts), keys, order) if parts else spark.createDataFrame([], schema)


def observed(keys: DataFrame, found: DataFrame, on: list[str], empty: dict) -> DataFrame:
    """The result of each of keys, and the empty value for those that have none yet."""
    there = found.withColumn("_there", F.lit(True))
    joined = keys.join(there, on, "left")
    return joined.select(*on, *[F.when(F.col("_there"), F.col(c)).otherwise(F.lit(v).cast(found.schema[c].dataType)).alias(c) for c, v in empty.items()])


def caught(batch: DataFrame, search: Callable[[DataFrame], DataFrame], key: str, empty: Callable[[DataFrame], DataFrame], deepest: int = 24) -> list[DataFrame]:
    """search(batch) as stored tables, with empty(rows) for the rows that make it fail, so that what fails for one user ends no stream.

    A batch that fails is halved by the hash of its key and tried again, until what fails is one key's rows; a batch of n keys
    of which f fail is tried some f * log2(n) times. Rows of keys whose hashes agree in `deepest` bits stay together.
    """
    bits = F.xxhash64(key)

    def tried(rows: DataFrame, depth: int) -> list[DataFrame]:
        try:
            return [cut(search(rows))]
        except (PySparkException, Py4JError):
            if depth == deepest or rows.select(key).distinct().limit(2).count() < 2:
                return [cut(empty(rows))]
            side = F.shiftrightunsigned(bits, depth).bitwiseAND(F.lit(1))
            return [found for half in (0, 1) for found in tried(rows.filter(side == half), depth + 1)]

    return tried(cut(batch), 0)


# Results that follow the versions of a library


def follow(spark: SparkSession, library: str, root: str, value: Callable[[int, list[str]], DataFrame]) -> str:
    """Emits value(version, changed names) for each version of a library that has not been followed yet; the path of all emissions.

    Versions come from the manifests as a stream, one batch a version, and only what a version has changed is computed again. The same call goes on
    where the last one ended; an emission that was not ended is written anew.
    """
    path = f"{root}/emissions"
    stream = spark.readStream.schema("version long, changed array<string>").option("maxFilesPerTrigger", 1).json(f"{library}/manifests")

    def emit(batch: DataFrame, number: int) -> None:
        for row in sorted(batch.collect()):  # the manifests of a batch: one row
            value(row["version"], list(row["changed"])).withColumn("version", F.lit(row["version"])).write.mode("overwrite").parquet(f"{path}/of={row['version']}")

    query = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(emit).start()
    query.awaitTermination()
    return path
