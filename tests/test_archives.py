import io
import json
import random
import zipfile

import pyarrow as pa
import pytest
from archives import sample_archive
from pyspark.sql import functions as F

from glossmill.plans import imports
from glossmill.sources import archive, tables
from glossmill.sources.elements import NotAnArray, elements


def chunked(raw, n):
    return (raw[k : k + n] for k in range(0, len(raw), n))


def some_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rng.randrange(1000)
    if kind == 1:
        return "".join(rng.choice('ab\\"[]{},\n é😀') for _ in range(rng.randrange(8)))
    if kind in (2, 3):
        return None if kind == 2 else "\\" * rng.randrange(5)
    return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind < 6 else {'k\\"': some_value(rng, depth + 1), "x": some_value(rng, depth + 1)}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50, 1 << 20])
def test_elements_are_those_of_the_parsed_array(chunk):
    rng = random.Random(chunk)
    for _ in range(300):
        values = [some_value(rng) for _ in range(rng.randrange(6))]
        raw = json.dumps(values, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        assert [json.loads(x) for x in elements(chunked(raw, chunk))] == values


@pytest.mark.parametrize("raw", [b"", b" ", b"{}", b"[1", b"[1,2]x", b"[1,2}", b'["a]', b"1", b'[["a"'])
@pytest.mark.parametrize("chunk", [1, 100])
def test_what_is_no_array_is_told(raw, chunk):
    with pytest.raises(NotAnArray):
        list(elements(chunked(raw, chunk)))


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_both_ways_of_reading_give_the_same_parts(spark, tmp_path, method):
    (tmp_path / "a.zip").write_bytes(zipped([("index.json", '{"title":"A"}'), ("x/term_bank_1.json", '[["a"],[]]'), ("term_meta_bank_1.json", "[]"), ("notes.txt", "x"), ("tag_bank_1.json", "[1]"), ("term_bank_2.json", "[1,")], method))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "_c.zip").write_bytes(sample_archive())
    name = F.element_at(F.split("path", "/"), -1)
    key = lambda df: sorted((tuple(r) for r in df.withColumn("path", name).collect()), key=repr)
    streamed = key(archive.streamed(spark, str(tmp_path)))
    assert streamed == key(archive.members(spark, f"{tmp_path}/[ab].zip")) == key(archive.streamed(spark, f"file:{tmp_path}/[ab].zip"))
    found = {(r[0], r[2], r[4], r[5]) for r in streamed}
    if method == zipfile.ZIP_BZIP2:
        assert sum(r[6] is not None for r in streamed) == 5
    else:
        assert {("a.zip", "x/term_bank_1.json", 0, '["a"]'), ("a.zip", "x/term_bank_1.json", 1, "[]"), ("a.zip", "term_meta_bank_1.json", -1, None), ("a.zip", "tag_bank_1.json", -1, None), ("b.zip", None, -1, None)} <= found
        assert {(r.path.rpartition("/")[2], r.member): r.error for r in archive.errors(archive.streamed(spark, str(tmp_path))).collect()} == {("a.zip", "term_bank_2.json"): "the array does not end", ("b.zip", None): "File is not a zip file"}


def test_a_member_is_a_task(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped([(f"term_bank_{k}.json", "[[1]]") for k in range(7)]))
    rows = archive.streamed(spark, str(tmp_path / "a.zip"), 1).withColumn("task", F.spark_partition_id()).filter("pos = 0")
    assert rows.select("member", "task").distinct().count() == 7 == rows.select("task").distinct().count()
    for size, tasks in ((10, 4), (15, 3), (None, 1)):  # members of five bytes; small ones share a task
        assert archive.streamed(spark, str(tmp_path / "a.zip"), size).select(F.spark_partition_id()).distinct().count() == tasks


def test_a_bank_of_141_mb_in_an_archive_of_over_two_gib(spark, tmp_path):
    """The archive lies behind a hole of 2.2 GiB, so all its offsets are beyond what a row could hold."""
    path, n = tmp_path / "large.zip", 143_360
    with open(path, "wb") as file:
        file.truncate(2_400_000_000)
    element = json.dumps(["語", "ご", "n", "", 1, ["x" * 950], 1, ""], ensure_ascii=False)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("term_bank_1.json", "w") as bank:
        bank.write(b"[")
        for k in range(0, n, 1024):
            bank.write((",".join([element] * 1024) + ("," if k + 1024 < n else "]")).encode())
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("term_bank_1.json").file_size > 141_000_000
    found = archive.streamed(spark, str(path)).filter("pos >= 0").agg(F.count(F.lit(1)), F.count_distinct("pos"), F.max("pos"), F.sum((F.col("text") == element).cast("int"))).first()
    assert tuple(found) == (n, n, n - 1, n)


def test_members_with_an_element_that_is_no_json_are_told_and_not_read(spark):
    rows = [("a.zip", 0, "term_bank_1.json", '[["a","b","n","",1,["x"],1],["c" "d"]]'), ("a.zip", 1, "term_bank_2.json", '[["e","f","n","",1,["x"],1]]'), ("a.zip", 2, "term_meta_bank_1.json", None), ("b.zip", 0, "term_bank_1.json", "[nope]")]
    rows = spark.createDataFrame(rows, "path string, ord int, member string, text string")
    assert {(r.path, r.ord, r.error) for r in archive.errors(rows).collect()} == {("a.zip", 0, "element 1 is no JSON"), ("b.zip", 0, "element 0 is no JSON")}
    entries, catalog = imports.import_archives(rows)
    assert [r.expression for r in entries.collect()] == ["e"]
    assert [(r.name, r.entry_count) for r in catalog.collect()] == [("Unknown Dictionary", 0)]


def test_written_archives_can_be_read_again(spark, tmp_path):
    rows = [(f"{d}.zip", k, f"term_bank_{k}.json", json.dumps([[d, k]])) for d in "ab" for k in range(5)]
    members = spark.createDataFrame(rows, "path string, ord int, member string, text string").repartition(4)
    folder = f"{tmp_path}/out"
    for _ in range(2):  # again, as a task that is run once more
        assert sorted((r.path, r.members) for r in archive.write(members, folder).collect()) == [("a.zip", 5), ("b.zip", 5)]
    assert sorted(r.text for r in archive.streamed(spark, folder).filter("pos = 0").collect()) == sorted(t[1:-1] for _, _, _, t in rows)
    assert archive.streamed(spark, folder).filter("error is not null").count() == 0


def test_the_import_calls_each_reader_of_payloads_once(spark):
    """A filter on their results does not make them be computed again, and ranks are read once for the entries and the catalog."""
    members = spark.createDataFrame([("a.zip", 0, "index.json", '{"title":"A"}'), ("a.zip", 1, "term_meta_bank_1.json", '[["x","freq",3],["x","pitch",{"pitches":[{"position":1}]}],["y","freq",0]]')], "path string, ord int, member string, text string")
    usable = archive.usable_meta(archive.parsed(members))
    assert usable._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.expression, r.type, r.frequency, r.pitch) for r in usable.collect()) == [("x", "freq", 3, None), ("x", "pitch", None, "1")]
    assert archive.meta(usable).count() == 2 and archive.meta_counts(usable).first().n == 2


def test_python_tasks_are_handed_few_bytes_at_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_HANDED", 1 << 20)
    before = spark.conf.get(tables.HANDED)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pylist([{"n": b.num_rows}]) for b in batches)
    handed = [r.n for r in tables.cut(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(handed) == 4000 and max(handed) < 1000 and spark.conf.get(tables.HANDED) == before
