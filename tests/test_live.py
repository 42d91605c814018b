import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from compare import DATA, of_duck, of_spark
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossmill.plans import library
from glossmill.plans import queries as lexicon
from glossmill.sources import versions
from glossmill.streaming import live, reactive

SCHEMA = "user long, ts timestamp, id long, value string"
COLUMNS = ("user", "ts", "id", "value")


def keystrokes(seed, users=6, n=60):
    rng = random.Random(seed)
    at, out = datetime(2024, 1, 1), []
    for k in range(n):
        at += timedelta(minutes=rng.choice([1, 5, 29, 30, 31, 90]))
        out.append((rng.choice([*range(users), None]), at, k, rng.choice(["a", "b", None])))
    return out


def run(spark, path, operator, batches, each=None, quiet=1.5):
    """Feeds the batches to one stream after the other, the stream being started again for each."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = operator(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), *COLUMNS, quiet=quiet)
        live.run_until_quiet(live.start(stream, f"{path}/run", each), quiet)
    return spark.read.schema(SCHEMA).parquet(f"{path}/run/out") if each is None else None


def test_sessions_close_without_later_input(spark, tmp_path):
    events = keystrokes(1)
    found = run(spark, tmp_path, live.debounce, [events])
    batch = reactive.debounce(spark.createDataFrame(events, SCHEMA), "user", "ts", "id")
    assert of_spark(found) == of_spark(batch)


def test_sessions_over_several_batches_are_those_of_one(spark, tmp_path):
    """Two files in one run: the quiet time does not pass between them."""
    events = keystrokes(2)
    spark.createDataFrame(events[:25], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = run(spark, tmp_path, lambda *a, **k: live.debounce(*a, **(k | {"quiet": 6})), [events[25:]], quiet=6)
    assert of_spark(found) == of_spark(reactive.debounce(spark.createDataFrame(events, SCHEMA), "user", "ts", "id"))


@pytest.mark.parametrize("seed", [3, 4])
def test_latest_queries_do_not_depend_on_batches(spark, tmp_path, seed):
    """Inputs come in any order and in several runs; the table holds each user's latest one."""
    events, rng, root = keystrokes(seed), random.Random(seed), f"{tmp_path}/table"
    mixed = rng.sample(events, len(events))
    cut = rng.randrange(1, len(mixed))
    run(spark, tmp_path, live.latest, [mixed[:cut], mixed[cut:]], lambda batch, n: live.put_batch(batch, n, root, ["user"], ["ts", "id"]))
    found = live.results(spark, root, SCHEMA, ["user"], ["ts", "id"]).select("user", "value")
    assert of_spark(found) == of_spark(reactive.latest_queries(spark.createDataFrame(events, SCHEMA), "user", "ts", "id", "value"))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "table"), "k long, at long, v string"
    put = lambda n, rows: live.put_batch(spark.createDataFrame(rows, schema), n, root, ["k"], ["at"])
    read = lambda: sorted((r.k, r.v) for r in live.results(spark, root, schema, ["k"], ["at"]).collect())
    users = spark.createDataFrame([(1,), (2,), (9,)], "k long")
    seen = lambda: sorted(tuple(r) for r in live.observed(users, live.results(spark, root, schema, ["k"], ["at"]), ["k"], {"v": ""}).collect())
    assert read() == [] and seen() == [(1, ""), (2, ""), (9, "")]
    assert put(0, [(1, 5, "a"), (1, 4, "z"), (2, 1, None)]) == 1 and read() == [(1, "a"), (2, None)]
    assert put(0, [(1, 9, "again")]) == 1 and read() == [(1, "a"), (2, None)]
    assert put(1, [(1, 3, "late"), (3, 1, "c")]) == 2 and read() == [(1, "a"), (2, None), (3, "c")]
    assert seen() == [(1, "a"), (2, None), (9, "")]
    monkeypatch.setattr(live, "PARTS", 2)
    assert put(2, [(2, 2, "b")]) == 3 and read() == [(1, "a"), (2, "b"), (3, "c")]
    assert len(versions.manifest(spark, root)["parts"]) == 1


def test_only_changed_names_are_emitted(spark, tmp_path):
    bank = lambda name, n: [(f"{name}.zip", 0, "index.json", f'{{"title":"{name}"}}'), (f"{name}.zip", 1, "term_bank_1.json", "[" + ",".join(f'["{name}{k}","","","",1,["x"],1]' for k in range(n)) + "]")]
    members = lambda rows: spark.createDataFrame(rows, "path string, ord int, member string, text string")
    root, out, asked = str(tmp_path / "library"), str(tmp_path / "out"), []

    def value(version, names):
        asked.append((version, names))
        return spark.createDataFrame([(n,) for n in names], "name string").join(library.entries(spark, root, version).groupBy(F.col("dictionary_name").alias("name")).count(), "name", "left").fillna(0)

    library.add(spark, root, members(bank("A", 2) + bank("B", 3)))
    path = live.follow(spark, root, out, value)
    library.delete(spark, root, "B")
    library.add(spark, root, members(bank("A", 4)))
    live.follow(spark, root, out, value)
    live.follow(spark, root, out, value)
    assert asked == [(1, ["A", "B"]), (2, ["B"]), (3, ["A"])]
    assert sorted((r.version, r.name, r["count"]) for r in spark.read.parquet(path).collect()) == [(1, "A", 2), (1, "B", 3), (2, "B", 0), (3, "A", 4)]


@pytest.mark.parametrize("name", ["live_debounce", "live_results"])
def test_queries(spark, duck, name):
    assert of_spark(lexicon.QUERIES[name](spark, DATA)) == of_duck(duck, lexicon.SQL[name])


@pytest.mark.parametrize("operator", ["debounce", "distinct"])
def test_a_spread_user_is_as_in_one_window(spark, operator):
    events = [(1 if k % 3 else k % 5, at, k, value) for k, (_, at, _, value) in enumerate(keystrokes(7, n=200))] + [(None, datetime(2024, 1, 1), 900, "a"), (None, datetime(2024, 1, 1), 901, "a")]
    table = spark.createDataFrame(events, SCHEMA).repartition(5)
    apply = (lambda spread: reactive.debounce(table, "user", "ts", "id", spread=spread)) if operator == "debounce" else (lambda spread: reactive.distinct_until_changed(table, "user", "ts", "id", "value", spread=spread))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert of_spark(apply(True)) == of_spark(apply(False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_what_fails_for_some_keys_is_empty_for_them_alone(spark):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(40)] * 2, "k long, v string")
    bad = {3, 17}
    search = lambda df: df.withColumn("v", F.when(F.col("k").isin(*bad), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("v")))
    found = live.caught(rows, search, "k", lambda df: df.withColumn("v", F.lit("")))
    assert sorted(tuple(r) for part in found for r in part.collect()) == sorted((k, "" if k in bad else f"v{k}") for k in range(40) for _ in range(2))
    assert len(live.caught(rows, lambda df: df, "k", lambda df: df)) == 1 and live.caught(rows.limit(0), search, "k", lambda df: df)[0].count() == 0


class Counted:
    """A state store of one user that counts the messages to it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, name, schema):
        return self

    def getCurrentProcessingTimeInMs(self):
        return 1000

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            if name == "registerTimer":
                self.timers.add(args[0])
            if name == "deleteTimer":
                self.timers.discard(args[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": sorted(self.timers)}.get(name)

        return call


@pytest.mark.parametrize("kind", ["debounce", "latest"])
def test_an_input_takes_few_messages_to_the_state_store(kind):
    schema = StructType([StructField(c, t) for c, t in (("user", LongType()), ("ts", LongType()), ("id", LongType()), ("value", StringType()))])
    processor, store = live._Debounce(schema, 3, 60) if kind == "debounce" else live._Latest(schema, 3), Counted()
    processor.init(store)
    feed = lambda at: list(processor.handleInputRows((1,), iter([pd.DataFrame([(1, at, at, "a"), (1, at - 1, 9, "b")], columns=schema.fieldNames())]), store))
    feed(5)
    assert store.calls <= 3 and store.timers == {4000}
    store.calls = 0
    feed(7)
    assert store.calls <= 4 and store.timers == {4000}
    store.calls = 0
    expired = lambda at: [tuple(r) for t in processor.handleExpiredTimer((1,), store, ExpiredTimerInfo(at)) for r in t.itertuples(index=False)]
    assert expired(3999) == [] and expired(4000) == [(1, 7, 7, "a")]
    assert store.calls <= 3
