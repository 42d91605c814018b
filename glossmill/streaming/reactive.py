"""Debounced search input: batch forms over stored events, and streaming forms of the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from glossmill.sources.tables import cut

GAP = "30 minutes"


def _beside(events: DataFrame, user: str, at: str, tie: str, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """events with _next: `after` of the user's following event, and _before, _nth: `before` of the one before it, and whether there is any.

    Events are put into ranges of (user, time), so a user with a large part of all events is in many tasks. Within a range the
    neighbour is the next row; at its ends it is the end of the user's nearest other range, of a table of two values a range
    and user.
    """
    order = [F.col(user).asc_nulls_first(), F.col(at), F.col(tie)]
    value = F.struct((F.lit(True) if after is None else after).alias("after"), (F.lit(True) if before is None else before).alias("before"))
    ranged = cut(events.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", user).orderBy(at, tie)
    inner = ranged.withColumns({"_inner_next": F.lead("_value").over(own), "_inner_before": F.lag("_value").over(own)})
    place = F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"))
    ends = ranged.groupBy("_part", F.col(user).alias("_user")).agg(F.min_by("_value", place).alias("_first"), F.max_by("_value", place).alias("_last"))
    across = Window.partitionBy("_user").orderBy("_part")
    ends = ends.select("_user", F.col("_part").alias("_of"), F.lead("_first").over(across).alias("_outer_next"), F.lag("_last").over(across).alias("_outer_before"))
    joined = inner.join(ends, (F.col("_part") == F.col("_of")) & F.col(user).eqNullSafe(F.col("_user")))
    following, previous = F.coalesce("_inner_next", "_outer_next"), F.coalesce("_inner_before", "_outer_before")
    found = joined.withColumns({"_next": following["after"], "_before": previous["before"], "_nth": F.when(previous.isNull(), 1).otherwise(2)})
    return found.drop("_value", "_part", "_inner_next", "_inner_before", "_user", "_of", "_outer_next", "_outer_before")


def debounce(events: DataFrame, user: str, at: str, tie: str, gap: str = GAP, spread: bool = False) -> DataFrame:
    """Events that no other event of the user follows within the gap.

    `spread` is for tables in which one user has a large part of all events: ranges of time take the place of a window a user.
    """
    if spread:
        beside = _beside(events, user, at, tie, after=F.col(at)).drop("_before", "_nth")
    else:
        beside = events.withColumn("_next", F.lead(at).over(Window.partitionBy(user).orderBy(at, tie)))
    return beside.filter(F.col("_next").isNull() | (F.col("_next") >= F.col(at) + F.expr(f"interval {gap}"))).drop("_next")


def distinct_until_changed(events: DataFrame, user: str, at: str, tie: str, value: str, spread: bool = False) -> DataFrame:
    """Events whose value differs from the user's event before; `spread` as in debounce()."""
    if spread:
        found = _beside(events, user, at, tie, before=F.col(value))
        return found.filter((F.col("_nth") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_next", "_before", "_nth")
    before = F.lag(value).over(Window.partitionBy(user).orderBy(at, tie))
    nth = F.row_number().over(Window.partitionBy(user).orderBy(at, tie))
    return events.withColumn("_before", before).withColumn("_nth", nth).filter((F.col("_nth") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_nth")


def stream_debounce(events: DataFrame, user: str, at: str, tie: str, value: str, gap: str = GAP, late: str = "1 hour") -> DataFrame:
    """Streaming debounce: the last event of each session. A session is told once the watermark has passed its end."""
    sessions = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(user, F.session_window(at, gap))
    return sessions.agg(F.max(F.struct(at, tie, value)).alias("last")).select(user, f"last.{at}", f"last.{tie}", f"last.{value}")


def stream_distinct(events: DataFrame, user: str, at: str, tie: str, value: str) -> DataFrame:
    """Streaming distinct_until_changed: the state of a user is the last value. Events of a micro-batch are put in order.

    Null is a value of its own, as in the batch form.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    out = StructType([StructField(c, kinds[c]) for c in (user, at, tie, value)])

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values([at, tie], ignore_index=True)
        null = rows[value].isna()
        new = (rows[value] != rows[value].shift()) & ~(null & null.shift(fill_value=False))
        first = None if null.iloc[0] else rows[value].iloc[0]
        new.iloc[0] = not state.exists or state.get[0] != first
        last = rows[value].iloc[-1]
        state.update((None if null.iloc[-1] else getattr(last, "item", lambda: last)(),))
        yield rows.loc[new, [user, at, tie, value]]

    return events.groupBy(user).applyInPandasWithState(changed, out, StructType([StructField("last", kinds[value])]), "append", GroupStateTimeout.NoTimeout)


def latest_queries(batch: DataFrame, user: str, at: str, tie: str, value: str) -> DataFrame:
    """The query of each user that supersedes the others of a micro-batch."""
    return batch.groupBy(user).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def run_available(stream: DataFrame, root: str, each: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Runs a stream over what is there now into Parquet below root, and returns the path of the results.

    Offsets and state are below root too, so that the same call goes on where the last one ended.
    """
    path = f"{root}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        query = writer.foreachBatch(lambda batch, n: each(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
    return path


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream. The pattern finds the table whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
