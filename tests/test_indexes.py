import random

import pytest
from compare import of_spark
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.operators import cards, catalog, consolidate, containment, prefixes, search
from glossmill.plans import fixtures as fx
from glossmill.sources import notes
from glossmill.sources.archive import _file_system

MORE = ("pitch_accent", "parts_of_speech", "dictionary_name", "example_sentence", "example_sentence_translation", "audio_file")
ENTRY = "id long, expression string, reading string, definitions array<string>, frequency int, " + ", ".join(f"{c} string" for c in MORE)
LARGE = "/root/testdata/sf0.1"


# Beginnings


def rows_read(df):
    """Rows that the scans of a plan have given, once it has run."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        below = plan.children()
        if below.isEmpty():
            return plan.metrics().apply("numOutputRows").value() if "Scan" in name else 0
        return sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_search_reads_a_small_part_of_the_index(spark, tmp_path):
    entries = fx.entries(spark, LARGE)
    paths = prefixes.build(entries, str(tmp_path))
    index = spark.read.schema(prefixes.INDEX).parquet(paths["index"])
    assert index.count() == 2 * entries.count()
    found = prefixes.hits(index, "hot gea")
    assert {r.id for r in found.collect()} == {r.id for r in entries.filter("expression like 'hot gea%'").collect()}
    assert 0 < rows_read(found) < 0.05 * 2 * entries.count()
    assert of_spark(prefixes.combined(spark, paths, "hot gea").select("id", "rnk")) == of_spark(search.combined(entries, "hot gea").select("id", "rnk"))


@pytest.mark.parametrize("query", ["a", "A%", "_b", "", " ab ", "ä", "\U0010ffff", "%", "z_", None, "a퟿"])
def test_the_index_finds_what_a_scan_finds(spark, tmp_path, query):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aAbB_%äÄ\U0010ffff") for _ in range(rng.randrange(4)))
    rows = [(k, word(), rng.choice([word(), None]), [], rng.randrange(3), *["x"] * 6) for k in range(150)] + [(150, None, "ab", [], 0, *["x"] * 6)]
    entries = spark.createDataFrame(rows, ENTRY)
    paths = prefixes.build(entries, str(tmp_path))
    for wildcards in (True, False):
        assert of_spark(prefixes.combined(spark, paths, query, wildcards=wildcards).select("id", "rnk")) == of_spark(search.combined(entries, query, wildcards=wildcards).select("id", "rnk"))


def test_many_queries_find_what_each_finds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aAbBä%") for _ in range(rng.randrange(5)))
    rows = [(k, word(), rng.choice([word(), None]), [], rng.randrange(3), *["x"] * 6) for k in range(200)]
    entries, asked = spark.createDataFrame(rows, ENTRY), ["a", "A", " ab ", "%", "ä", "bbbbbbbb", "", "  ", None, "aa"]
    found = search.combined_many(entries, spark.createDataFrame([(q,) for q in asked], "query string"), 7).select("query", "id", "rnk")
    expected = sorted((q, r.id, r.rnk) for q in {(q or "").strip() for q in asked} for r in search.combined(entries, q, 7, wildcards=False).collect())
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert search.combined_many(entries, spark.createDataFrame([], "query string")).count() == 0


# Consolidation


def some_entries(spark, seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", " ", "か", "食", "食べ", "x", None])
    rows = [(k, word(), word(), [word() for _ in range(rng.randrange(3))] if rng.random() < 0.9 else None, rng.randrange(-1, 3), *[word() for _ in MORE]) for k in range(n)]
    return spark.createDataFrame(rows, ENTRY)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_tables_are_merged_as_ranked_rows_are(spark, seed):
    entries = some_entries(spark, seed).fillna("", ["expression", "reading", *MORE]).withColumn("definitions", F.transform(F.coalesce("definitions", F.array().cast("array<string>")), lambda d: F.coalesce(d, F.lit(""))))
    ranked = entries.withColumn("rnk", F.row_number().over(Window.partitionBy(consolidate.reading_key()).orderBy(*search.rank_keys(), "id")))
    assert of_spark(consolidate.consolidate_all(entries, salts=3)) == of_spark(consolidate.consolidate(ranked))


def test_nulls_of_all_kinds_are_merged(spark):
    entries = some_entries(spark, 4)
    found = consolidate.consolidate_all(entries).collect()
    assert sorted(i for r in found for i in r.entry_ids) == list(range(120)) and consolidate.consolidate_all(entries.limit(0)).count() == 0


def test_a_hot_reading_is_spread_over_tasks(spark):
    rows = spark.range(40_000).selectExpr("id", "concat('e', id % 5000) as expression", "if(id % 2 = 0, 'hot', concat('r', id % 97)) as reading", "array(concat('d', id % 9000), 'same') as definitions", "int(id % 7) as frequency", *[f"'' as {c}" for c in MORE])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in consolidate._values(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8
    hot = consolidate.consolidate_all(rows).filter("reading = 'hot'").first()
    assert len(hot.entry_ids) == 20_000 and len(hot.definitions) == 4500 + 1 and len(hot.alternative_expressions) == 2499


# Containment


@pytest.mark.parametrize("gram", [1, 3, 9])
def test_containment_equals_comparing_all(spark, gram):
    rng = random.Random(gram)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randrange(7)))
    hay, needles = [word() for _ in range(60)] + [None], [word() for _ in range(40)] + [None, "", "never"]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    expected = sorted({(h, n) for h in hay for n in needles if h is not None and n is not None and n in h})
    assert sorted(tuple(r) for r in containment.containing(frame(hay), frame(needles), gram).collect()) == expected
    assert containment.containing(frame(hay), frame([]), gram).count() == containment.containing(frame([None]), frame(needles), gram).count() == 0
    either = {h for h in hay if h is not None and any(n is not None and (n in h or h in n) for n in needles)}
    assert {r.text for r in containment.touching(frame(hay), frame(needles), gram).collect()} == either


def test_names_meet_without_a_nested_loop(spark):
    there = fx.names_there(spark, LARGE)
    for found in (catalog.installed(fx.items(spark, LARGE), there), catalog.installed_simple(fx.items(spark, LARGE), there)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() > 0


# Notes


def cards_of(spark, names):
    return spark.createDataFrame([(n, "r", *[f"{n}-{f}" for f in cards.FIELDS]) for n in names], ", ".join(f"{c} string" for c in (*notes.KEYS, *(f"field_{f}" for f in cards.FIELDS))))


def test_an_export_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    for names, deck, export in ((["a", "b"], "One", "x"), (["a", "b"], "One", "x"), (["b", "c"], "One", "y"), (["a"], "Two", "z"), ([], "Three", "w")):
        notes.export_notes(cards_of(spark, names).repartition(3), path, deck, export)
    found = [(r.deck, r.name, r.expression, r.field_front) for r in notes.notes(spark, path).collect()]
    assert sorted(found) == [(1, "One", "a", "a-front"), (1, "One", "b", "b-front"), (1, "One", "c", "c-front"), (2, "Two", "a", "a-front")]
    assert [(e["export"], e["deck"], e["notes"]) for e in notes.exports(path)] == [("w", 3, 0), ("x", 1, 2), ("y", 1, 2), ("z", 2, 1)]
    assert notes.notes(spark, str(tmp_path / "none")).count() == 0


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    rows = cards_of(spark, [f"n{k}" for k in range(40)]).repartition(4)
    broken = rows.withColumn("field_front", F.when(F.col("expression") == "n7", F.raise_error(F.lit("broken"))).otherwise(F.col("field_front")))
    with pytest.raises(Exception, match="broken"):
        notes.export_notes(broken, str(tmp_path), "One", "x")
    assert notes.exports(str(tmp_path)) == [] and not [p for p in tmp_path.rglob("*.parquet")]
    notes.export_notes(rows, str(tmp_path), "One", "x")
    assert notes.notes(spark, str(tmp_path)).count() == 40


def test_paths_of_the_shared_folder(tmp_path):
    for given in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        assert _file_system(given)[1] == str(tmp_path)


def test_many_queries_go_to_the_entries_and_not_the_entries_to_the_driver(spark):
    entries = spark.createDataFrame([(1, "Hot plate", "plate", 3), (2, "hot", None, 0)], "id long, expression string, reading string, frequency int")
    queries = spark.createDataFrame([(f"{q}{i}",) for q in ("hot", "PLATE", "zz") for i in ("", *range(90))], "query string")
    sent = search.combined_many(entries, queries)
    shuffled = search.combined_many(entries, queries, most=0)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan(sent) and "BuildLeft" not in plan(sent)
    assert "SortMergeJoin" in plan(shuffled) and "BroadcastHashJoin" not in plan(shuffled)
    assert sorted(map(tuple, sent.select("query", "id", "rnk").collect())) == sorted(map(tuple, shuffled.select("query", "id", "rnk").collect())) == [("PLATE", 1, 1), ("hot", 1, 2), ("hot", 2, 1)]


def test_notes_of_an_export_that_is_there_are_not_computed_again(spark, tmp_path):
    fields = {f"field_{f}": F.lit("x") for f in cards.FIELDS}
    rows = spark.range(3).select(F.col("id").cast("string").alias("expression"), F.lit("r").alias("reading")).withColumns(fields)
    notes.export_notes(rows, str(tmp_path), "Deck", "a")
    notes.export_notes(rows.withColumn("reading", F.raise_error(F.lit("computed again")).cast("string")), str(tmp_path), "Deck", "a")
    assert notes.notes(spark, str(tmp_path)).count() == 3
