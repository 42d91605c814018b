import json
import threading

import pytest
from pyspark.sql import functions as F

from glossmill.operators import fulltext, postings
from glossmill.plans import imports, library
from glossmill.sources import versions

MEMBERS = "path string, ord int, member string, text string"


def members(spark, **dictionaries):
    """One archive a name, of (expression, definition) pairs, and of ranks where they are a dict."""
    rows = []
    for name, found in dictionaries.items():
        rows.append((f"{name}.zip", 0, "index.json", json.dumps({"title": name})))
        if isinstance(found, dict):
            rows.append((f"{name}.zip", 1, "term_meta_bank_1.json", json.dumps([[k, "freq", v] for k, v in found.items()])))
        else:
            rows.append((f"{name}.zip", 1, "term_bank_1.json", json.dumps([[e, "", "", "", 1, [d], 1] for e, d in found])))
    return spark.createDataFrame(rows, MEMBERS)


def found(spark, root, query, version=None):
    return sorted(r.expression for r in library.find(spark, root, query, version=version).collect())


def rebuilt(spark, root, query):
    rows = library.entries(spark, root).withColumn("definition", F.array_join("definitions", "\n"))
    index = fulltext.token_table(rows, "id", imports.INDEXED)
    return sorted(r.expression for r in rows.join(fulltext.match(index, fulltext.match_query(query)), "id", "left_semi").collect())


def test_the_index_follows_changes(spark, tmp_path):
    root = str(tmp_path)
    assert library.add(spark, root, members(spark, A=[("cat", "a pet"), ("dog", "a pet")], B=[("cow", "no pet")])) == (True, 1, ("A", "B"), 3, None)
    assert found(spark, root, "pet") == rebuilt(spark, root, "pet") == ["cat", "cow", "dog"]
    assert library.add(spark, root, members(spark, C=[("pet", "x"), ("ant", "no pet")])).version == 2
    assert library.delete(spark, root, "A") == (True, 3, ("A",), 2, None)
    for query in ("pet", "no pet", "cat", "x"):
        assert found(spark, root, query) == rebuilt(spark, root, query)
    assert library.add(spark, root, members(spark, B=[("hen", "a pet")])).success  # replaces B
    assert found(spark, root, "pet") == rebuilt(spark, root, "pet") == ["ant", "hen", "pet"]
    assert found(spark, root, "pet", version=1) == ["cat", "cow", "dog"] and found(spark, root, "pet", version=3) == ["ant", "cow", "pet"]
    content = versions.manifest(spark, root)
    assert len(content["index"]["segments"]) == 3 and len(content["index"]["tombstones"]) == 2 and len(content["entries"]) == 3
    assert library.tidy(spark, root).success
    content = versions.manifest(spark, root)
    assert len(content["index"]["segments"]) == 1 and not content["index"]["tombstones"] and len(content["entries"]) == 1
    assert found(spark, root, "pet") == rebuilt(spark, root, "pet") == ["ant", "hen", "pet"]
    assert [r.id for r in library.entries(spark, root).orderBy("id").collect()] == [3 + 1, 3 + 2, 6]
    assert sorted((r.name, r.entry_count) for r in library.catalog(spark, root).collect()) == [("B", 1), ("C", 2)]


def test_an_import_without_ranks_writes_only_its_own_entries(spark, tmp_path):
    root = str(tmp_path)
    library.add(spark, root, members(spark, A=[("cat", "x")]))
    first = versions.manifest(spark, root)["entries"][0]["path"]
    library.add(spark, root, members(spark, B=[("dog", "x")]))
    assert versions.manifest(spark, root)["entries"][0]["path"] == first
    assert library.add(spark, root, members(spark, R={"cat": 7, "cow": 3})) == (True, 3, ("R",), 2, None)
    content = versions.manifest(spark, root)
    assert [r.frequency for r in library.entries(spark, root).orderBy("id").collect()] == [7, 0]
    assert content["changed"] == ["A", "R"] and len(content["index"]["segments"]) == 2


def test_append_keeps_entries_of_the_same_name(spark, tmp_path):
    root = str(tmp_path)
    for append in (False, True, False):
        library.add(spark, root, members(spark, A=[("cat", "x"), ("dog", "x")]), append)
        assert library.entries(spark, root).count() == (4 if append else 2)
    assert found(spark, root, "cat") == ["cat"]


def test_a_failed_import_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    library.add(spark, root, members(spark, A=[("cat", "x")]))
    broken = members(spark, B=[("dog", "x")]).withColumn("text", F.when(F.col("ord") == 1, F.raise_error(F.lit("no such store"))).otherwise(F.col("text")))
    result = library.add(spark, root, broken)
    assert (result.success, result.version) == (False, 1) and result.error
    assert versions.latest(spark, root) == 1 and found(spark, root, "cat") == ["cat"]


def test_what_was_written_goes_where_the_commit_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    library.add(spark, root, members(spark, A=[("cat", "x")]))
    before = sorted(p.name for p in (tmp_path / "tables").iterdir())
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("the store is gone")))
    assert library.add(spark, root, members(spark, B=[("dog", "x")])) == (False, 1, (), 0, "the store is gone")
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == before


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    root, both = str(tmp_path), threading.Barrier(2)
    library.add(spark, root, members(spark, A=[("cat", "x")]))
    commit = versions.commit

    def together(*args):
        both.wait(60)
        return commit(*args)

    monkeypatch.setattr(versions, "commit", together)
    done = {}
    work = [threading.Thread(target=lambda n=n: done.update({n: library.add(spark, root, members(spark, **{n: [(n, "x")]}))})) for n in ("B", "C")]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(r.success for r in done.values()) == [False, True] and versions.latest(spark, root) == 2
    winner = next(n for n, r in done.items() if r.success)
    assert sorted(r.name for r in library.catalog(spark, root).collect()) == ["A", winner] and found(spark, root, winner) == [winner]
    with pytest.raises(versions.Conflict):
        commit(spark, root, 1, {})


def test_expired_versions_go_and_kept_ones_stay(spark, tmp_path):
    root = str(tmp_path)
    for n in "ABC":
        library.add(spark, root, members(spark, **{n: [(n, "x")]}))
    library.tidy(spark, root)
    gone = versions.expire(spark, root, keep=1)
    assert gone and found(spark, root, "x") == ["A", "B", "C"]
    assert versions.manifest(spark, root)["version"] == 4 and not (tmp_path / "manifests" / "v-00000000000000000003.json").exists()
    assert versions.expire(spark, root, keep=1) == []


def test_only_tokens_asked_for_are_read(spark, tmp_path):
    index = postings.with_rows(postings.EMPTY, spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, x string"), "id", ("x",), str(tmp_path), 1)
    index = postings.without_rows(index, spark.createDataFrame([(2,)], "id long"), str(tmp_path), 2)
    rows = fulltext.match(postings.tokens(spark, index), '"b"')
    assert "PushedFilters: [In(token, [b])]" in rows._jdf.queryExecution().executedPlan().toString() or "EqualTo(token,b)" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in rows.collect()] == [1]


def test_an_empty_library(spark, tmp_path):
    root = str(tmp_path)
    assert library.entries(spark, root).count() == 0 and library.catalog(spark, root).count() == 0 and found(spark, root, "x") == []
    assert library.delete(spark, root, "none").success and library.entries(spark, root).count() == 0
