import io
import zipfile
from datetime import datetime

import pytest
from archives import sample_archive
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.functions import structured
from glossmill.operators import cards, catalog, consolidate, enrich, fulltext, search, stats, store
from glossmill.plans import imports
from glossmill.sources import archive, tables
from glossmill.streaming import reactive

ENTRY = "id long, expression string, reading string, definitions array<string>, frequency int, rnk int"
MORE = ("pitch_accent", "parts_of_speech", "dictionary_name", "example_sentence", "example_sentence_translation", "audio_file")


def entries(spark, rows):
    return spark.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], ENTRY).withColumns({c: F.lit("") for c in MORE})


def test_consolidate_golden(spark):
    rows = [(1, "タベル", "たべる", ["to eat"], 0), (2, "食べる", "たべる", ["to eat", "to live on"], 200), (3, "喰べる", "たべる", ["to devour"], 900), (4, "猫", "ねこ", ["cat"], 0)]
    first, second = consolidate.consolidate(entries(spark, rows)).orderBy("first_rank").collect()
    assert (first.primary_id, first.primary_expression, first.alternative_expressions) == (2, "食べる", ["タベル", "喰べる"])
    assert (first.definitions, first.frequency, first.entry_ids) == (["to eat", "to live on", "to devour"], 200, [1, 2, 3])
    assert (second.primary_id, second.reading, second.frequency, second.entry_ids) == (4, "ねこ", 0, [4])


words = st.sampled_from(["", " ", "か", "食", "食べ", "x"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words, st.lists(words, max_size=2), st.integers(-1, 3)), max_size=8))
def test_consolidate_keeps_every_entry(spark, made):
    rows = [(k, e, r, d, f) for k, (e, r, d, f) in enumerate(made)]
    merged = consolidate.consolidate(entries(spark, rows)).collect()
    assert sorted(i for m in merged for i in m.entry_ids) == list(range(len(rows)))
    assert len({m.first_rank for m in merged}) == len(merged)
    assert all(m.primary_expression not in m.alternative_expressions for m in merged)


def test_prefix_without_wildcards(spark):
    rows = entries(spark, [(1, "h_t", "", [], 1), (2, "hot", "", [], 2)])
    assert [r.id for r in search.combined(rows, "h_t", wildcards=False).collect()] == [1]
    assert [r.id for r in search.combined(rows, " h_t ").orderBy("rnk").collect()] == [1, 2]
    assert search.combined(rows, None).count() == 0


def test_phrases(spark):
    rows = spark.createDataFrame([(1, "The cat, sat", None), (2, "cat", "sat"), (3, "category sat", "")], "id long, a string, b string")
    index = fulltext.token_table(rows, "id", ("a", "b"))
    ids = lambda q, **k: sorted(r.id for r in fulltext.match(index, q, **k).collect())
    assert ids('"cat sat"*') == [1]
    assert ids('"cat"*') == [1, 2]
    assert ids('"cat"*', prefix_last=True) == [1, 2, 3]
    assert ids('"cat""sat"*') == [1, 2]
    assert ids("") == ids('"?"') == []
    assert fulltext.match_query(' ab "c ') == '"ab ""c"*'


def test_enrichment_forms(spark):
    rows = entries(spark, [(1, "a", "", [], 0), (2, "a", "", [], 5), (3, "b", "", [], 0)])
    lookup = enrich.last_by(spark.createDataFrame([("a", 7, 1), ("a", 9, 2)], "k string, v int, pos int"), "k", "v", "pos")
    assert {r.id: r.frequency for r in enrich.overwrite(rows, lookup, "frequency").collect()} == {1: 9, 2: 9, 3: 0}
    assert {r.id: r.frequency for r in enrich.fill(rows, lookup, "frequency", 0).collect()} == {1: 9, 2: 5, 3: 0}


def test_bookkeeping(spark):
    log = spark.createDataFrame([(1, "a", datetime(2024, 1, 2)), (2, "b", datetime(2024, 1, 1))], "id long, query string, moment timestamp")
    new = spark.createDataFrame([(3, "a", datetime(2023, 1, 1))], log.schema)
    assert sorted(r.id for r in store.upsert(log, new, ["query"], ["moment", "id"]).collect()) == [2, 3]
    assert [r.id for r in store.recent(log, "moment", "id", 1).collect()] == [1]
    assert store.emptied(log).count() == 0
    assert [r.id for r in store.without(log, "query", "a").collect()] == [2]
    assert [r.id for r in store.numbered(log.select("query"), ["query"], 5).orderBy("query").collect()] == [5, 6]


def test_versions(spark, tmp_path):
    old = store.write_version(spark.range(3), str(tmp_path))
    held = store.read_version(spark, old)
    store.write_version(spark.range(5), str(tmp_path))
    assert held.count() == 3


@pytest.mark.parametrize(("item", "there", "expected"), [("jmdict_forms", "JMdict", True), ("jpdb_freq", "JPDBv2", False), ("kanjidic", "KANJIDIC (English)", True)])
def test_installed(spark, item, there, expected):
    items = catalog.known(spark).filter(F.col("id") == item)
    assert (catalog.installed(items, spark.createDataFrame([(there,)], "name string")).count() == 1) is expected


def test_export_skips_what_the_deck_has(spark, tmp_path):
    rows = entries(spark, [(1, "a", "x", ["<b>"], 3), (2, "b", "y", [], 0)])
    log = spark.createDataFrame([("a", "x", "Deck")], "expression string, reading string, deck_name string")
    made, logged = cards.export(rows, log, " Deck ")
    assert [r.id for r in made.collect()] == [2] and logged.count() == 1
    everything, _ = cards.export(rows, log, "Deck", force=True)
    assert {r.id: r.meaning for r in everything.collect()} == {1: "&lt;b&gt;", 2: ""}
    cards.write_cards(everything, str(tmp_path / "cards"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "cards")).count() == 2


def test_statistics(spark):
    assert tuple(stats.overview(a=spark.range(3), b=spark.range(0)).first()) == (3, 0)
    assert not stats.any_rows(spark.range(0))


def test_archives_on_disk(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(sample_archive())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    members = archive.members(spark, str(tmp_path))
    got, listed = imports.import_archives(members)
    again, listed_again = imports.import_archives(members, got, listed)
    more, _ = imports.import_archives(members, got, listed, append=True)
    assert (got.count(), again.count(), more.count(), listed_again.count()) == (3, 3, 6, 1)
    assert again.agg(F.min("id"), F.max("id")).first() == (4, 6)


def test_stream_distinct_over_several_batches(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, value string"
    source, root = str(tmp_path / "in"), str(tmp_path / "run")
    told = []
    for batch in ([(1, 1, "a"), (1, 2, "a"), (2, 3, "b")], [(1, 4, "a"), (1, 5, "c"), (2, 6, "b")]):
        spark.createDataFrame([(u, datetime(2024, 1, 1, 0, e), e, v) for u, e, v in batch], schema).coalesce(1).write.mode("append").parquet(source)
        stream = reactive.stream_distinct(spark.readStream.schema(schema).parquet(source), "user_id", "ts", "event_id", "value")
        path = reactive.run_available(stream, root)
        told = sorted(r.event_id for r in spark.read.parquet(path).collect())
    assert told == [1, 3, 5]


def test_latest_query_of_each_batch_is_searched(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, value string"
    source, root = str(tmp_path / "in"), str(tmp_path / "run")
    spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "h"), (1, datetime(2024, 1, 1), 2, "hot")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    path = reactive.run_available(stream, root, lambda batch: reactive.latest_queries(batch, "user_id", "ts", "event_id", "value"))
    assert [(r.user_id, r.value) for r in spark.read.parquet(path).collect()] == [(1, "hot")]


def test_settled_drops_what_was_stored_on_the_way(spark):
    inner = []

    def build():
        inner.extend(tables.stored(spark.range(n)) for n in (3, 4))
        return inner[0][0].join(inner[1][0], "id")

    df, path = tables.settled(spark, build)
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert [exists(p) for _, p in inner] == [False, False] and exists(path)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    kept = tables.stored(spark.range(2))
    assert exists(kept[1])


def test_imported_rows_of_the_sample(spark):
    entries, catalog = imports.import_archives(archive.unzipped(spark.createDataFrame([("sample.zip", bytearray(sample_archive()))], "path string, content binary")))
    found = [(r.id, r.expression, r.reading, r.definitions, r.frequency, r.pitch_accent, r.parts_of_speech, r.sequence_number) for r in entries.orderBy("id").collect()]
    assert found == [(1, "食べる", "食べる", ["to eat", "to live on"], 1234, "", "v1, P", 5), (2, "ねこ", "ねこ", ["cat"], 0, "", "n, P", 0), (3, "橋", "はし", ["a; b"], 0, "2", "n", 7)]
    assert [(r.name, r.version, r.revision, r.entry_count) for r in catalog.collect()] == [("Sample", "3", "r1", 3)]


def test_damaged_members_are_told_and_skipped(spark):
    """A member whose bytes are damaged, one with a wrong checksum, and a file that is no archive."""
    whole = sample_archive()
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as again:
        for name in z.namelist():
            again.writestr(name, z.read(name) if name != "term_bank_2.json" else b"[1,2,3]" * 500)
    broken = bytearray(out.getvalue())
    with zipfile.ZipFile(io.BytesIO(broken)) as z:
        info = z.getinfo("term_bank_2.json")
        at = info.header_offset + 30 + len(info.filename)
    broken[at : at + info.compress_size] = bytes([0xFF]) * info.compress_size
    files = [("a.zip", bytearray(whole)), ("b.zip", broken), ("c.zip", bytearray(b"no archive"))]
    members = archive.unzipped(spark.createDataFrame(files, "path string, content binary"))
    told = {(r.path, r.member) for r in members.collect() if r.error is not None}
    assert told == {("a.zip", "term_bank_2.json"), ("b.zip", "term_bank_2.json"), ("c.zip", None)}  # the one of a.zip is no array
    entries, catalog = imports.import_archives(members)
    assert entries.count() == 6 and catalog.count() == 1


def test_json_that_is_nested_too_deep_is_not_read(spark):
    nested = lambda n: '{"type":"structured-content","content":' + '{"content":[' * n + '"x"' + "]}" * n + "}"
    rows = spark.createDataFrame([(k, nested(n)) for k, n in enumerate((100, 5000, 200_000))] + [(3, '"]]]]" not json')], "id int, x string")
    found = rows.select("id", structured.structured_text("x").alias("text"), structured.frequency("x").alias("rank"), structured.pitch("x").alias("pitch")).orderBy("id").collect()
    assert [r.text for r in found][0] == "x" and [r.rank for r in found] == [0] * 4 and all(r.pitch == "" for r in found)
    deep = spark.createDataFrame([("d.zip", 0, "term_bank_1.json", '[["a","b","","",1,' + "[" * 5000 + "]" * 5000 + ']]', None), ("d.zip", 1, "term_bank_2.json", '[["c","d","","",1,["e"]]]', None)], "path string, ord int, member string, text string, error string")
    entries, _ = imports.import_archives(deep.withColumn("kind", archive.member_kind(F.col("member"))))
    assert [r.expression for r in entries.collect()] == ["c"]


def test_streamed_values_with_nulls_change_as_in_the_batch_form(spark, tmp_path):
    values = [None, None, "a", "a", None, None, "b"]
    for kind, of in (("string", lambda v: v), ("long", lambda v: None if v is None else ord(v)), ("double", lambda v: None if v is None else ord(v) / 2)):
        root = tmp_path / kind
        events = [(1, datetime(2024, 1, 1, 0, 0, k), k, of(v)) for k, v in enumerate(values)]
        schema = f"user long, ts timestamp, id long, value {kind}"
        for k, part in enumerate((events[:1], events[1:5], events[5:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(root / "in"))
            stream = spark.readStream.schema(schema).parquet(str(root / "in"))
            path = reactive.run_available(reactive.stream_distinct(stream, "user", "ts", "id", "value"), str(root / "run"))
        batch = reactive.distinct_until_changed(spark.read.schema(schema).parquet(str(root / "in")), "user", "ts", "id", "value")
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(r.id for r in batch.collect()) == [0, 2, 4, 6]


def test_null_tags_are_texts_where_asked(spark):
    rows = spark.createDataFrame([("a.zip", 0, "term_bank_1.json", '[["a","b",null,"",1,["x"],null,null],["c","d","n","",1,["y"],1]]')], "path string, ord int, member string, text string")
    rows = rows.withColumn("kind", archive.member_kind(F.col("member")))
    assert [r.parts_of_speech for r in archive.terms(rows).orderBy("pos").collect()] == ["", "n"]
    assert [r.parts_of_speech for r in archive.terms(rows, null_as_text=True).orderBy("pos").collect()] == ["null, null", "n"]


def test_published_versions_follow_deletes(spark, tmp_path):
    entries, catalog = imports.import_archives(archive.unzipped(spark.createDataFrame([("sample.zip", bytearray(sample_archive()))], "path string, content binary")))
    first = imports.publish(entries, catalog, str(tmp_path))
    found = lambda paths: {r.id for r in fulltext.match(imports.published(spark, paths)[2], '"live on"').collect()}
    assert found(first) == {1}
    second = imports.delete_dictionary(spark, first, str(tmp_path), "Sample")
    assert [t.count() for t in imports.published(spark, second)] == [0, 0, 0] and found(second) == set() and found(first) == {1}


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    keys = [tables.GUESSED, tables.MEASURED, tables.SHUFFLE_CLEANUP]
    before = [spark.conf.get(k, None) for k in keys]
    spark.range(0, 120_000, 1, 1).selectExpr("xxhash64(id) as id", "repeat('x', 500) as text").write.parquet(f"{tmp_path}/t")  # 1 MB of files, 60 MB of rows
    small = spark.read.parquet(f"{tmp_path}/t")
    plans = []
    found = small.alias("a").join(small.select(F.col("id").alias("k"), "text"), F.col("id") == F.col("k")).select("id", "a.text")
    class Writes:
        """Takes the place of a table: tells how it would be joined while it is stored."""

        sparkSession, schema = spark, found.schema

        @property
        def write(self):
            plans.append(found.select("*")._jdf.queryExecution().sparkPlan().toString())
            return found.write

    tables.stored(Writes())
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in found.select("*")._jdf.queryExecution().sparkPlan().toString()
    assert [spark.conf.get(k, None) for k in keys] == before


def test_cards_take_columns_of_their_entries_along(spark):
    entry = spark.createDataFrame([(1, "a", "b", ["<"], "", 0, "", "", "")], "id long, expression string, reading string, definitions array<string>, pitch_accent string, frequency int, audio_file string, example_sentence string, example_sentence_translation string")
    row = cards.cards(entry, F.col("expression").alias("_expression")).first()
    assert (row.id, row.meaning, row._expression) == (1, "&lt;", "a")
