import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import DATA, of_spark
from glossmill.llm import mixing, packing, quality, secrets
from glossmill.llm.common import table


def sized(rng, n, sources):
    return [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), "en", rng.choice(sources)) for k in range(n)]


def fill(sizes, weights, budget):
    """Targets by giving each source its weight of what is left, over and over."""
    target = dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    while open_:
        level = (budget - sum(2 * sizes[s] for s in sizes if s not in open_)) / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= weights[s] * level}
        if not full:
            return target | {s: weights[s] * level for s in open_} | {s: 2.0 * sizes[s] for s in sizes if s not in open_}
        open_ -= full
    return {s: 2.0 * n for s, n in sizes.items()}


def test_mix(make_docs):
    rows = sized(random.Random(2), 900, ["a", "a", "a", "b", "Z", "é", None])
    found = mixing.mix(make_docs(rows)).collect()
    assert len(found) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(s for s in size if s is not None) + [None]
    targets = fill(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()))
    for s in order:
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {size[s]}
        assert own[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in own) - targets[s]) <= 2 * max(r.size for r in own)
        expected = targets[s] / size[s]
        assert all(r.copies in (int(expected), int(expected) + 1) for r in own) and all(r.taken <= 2 * r.size for r in own)


def test_mix_does_not_depend_on_the_partitioning(make_docs):
    docs = make_docs(sized(random.Random(3), 300, ["a", "b"]))
    first = sorted(tuple(r) for r in mixing.mix(docs.repartition(1)).collect())
    assert first == sorted(tuple(r) for r in mixing.mix(docs.repartition(7, "n_chars")).collect())


def test_copies_are_rows(make_docs, odd, none):
    docs = make_docs(sized(random.Random(4), 200, ["a", "b", "c", None]))
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns
    times = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert mixing.take_copies(odd).count() == sum(r.copies for r in mixing.mix(odd).collect())
    assert mixing.mix(none).count() == mixing.take_copies(none).count() == 0


def test_copies_of_rows_that_differ_in_some_column_only(spark):
    """Three rows each of two languages, equal in id, source and text; each language keeps what the mix takes of it."""
    rows = [(1, "three words here", lang, "a", n, {"k": lang}) for lang in ("en", "de") for n in (1, 2, 2)] + [(2, "x " * 20, "en", "b", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, m map<string,string>")
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns
    times = {}
    for r in copies.collect():
        assert (r.doc_id, r.text, r.lang, r.source, r.n, r.m) in rows
        times[r.lang, r.doc_id] = times.get((r.lang, r.doc_id), 0) + 1
    assert times["de", 1] > 0 and times["en", 1] > 0
    assert sum(times.values()) == sum(r.copies for r in mixing.mix(docs).collect())
    for _ in range(2):
        assert of_spark(mixing.take_copies(docs.drop("m").repartition(5))) == of_spark(copies.drop("m"))


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 80)
        sizes = sorted((rng.randrange(0, 101) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randrange(-1, 6) for _ in range(n)], [rng.randrange(-1, 4) for _ in range(n)]
        bins, offsets = packing.best_fit(sizes, sources, clusters, 100)
        held = []
        for size, source, cluster, b, offset in zip(sizes, sources, clusters, bins, offsets, strict=True):
            fits = [(100 - h[0], k) for k, h in enumerate(held) if 100 - h[0] >= size and (source < 0 or source not in h[1]) and (cluster < 0 or cluster not in h[2])]
            expected = min(fits)[1] if fits else len(held)
            assert b == expected
            if b == len(held):
                held.append([0, set(), set()])
            assert offset == held[b][0]
            held[b][0] += size
            held[b][1].add(source)
            held[b][2].add(cluster)


def check_packing(found, docs, capacity):
    bins = {}
    for r in found:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: (r.bin_offset, r.bin_offset + r.n_words))
        at = 0
        for r in rows:
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        sources = [r.source for r in rows if r.source is not None]
        assert len(sources) == len(set(sources))
    assert sum(r.n_words for r in found) == sum(len((r.text or "").split()) for r in docs.collect())


def test_pack(make_docs, odd, none):
    rng = random.Random(6)
    rows = sized(rng, 400, ["a", "a", "b", "c", "d", None]) + [(1000 + k, "same words here", "en", f"s{k}") for k in range(30)]
    docs = make_docs(rows)
    found = packing.pack(docs, 50, 64).collect()
    check_packing(found, docs, 50)
    copies = [r.bin_id for r in found if r.doc_id is not None and r.doc_id >= 1000]
    assert len(copies) == len(set(copies)) == 30
    check_packing(packing.pack(odd, 2048).collect(), odd, 2048)
    assert {r.doc_id for r in packing.pack(odd).collect()} == {r.doc_id for r in odd.collect()}
    assert packing.pack(none).count() == 0


def test_pieces_are_the_text_again(make_docs, odd, odd_rows):
    docs = make_docs([(1, "  a  b\nc d\te f g ", "en", "s"), (2, "a b", "en", "s"), (3, "\n\n x" * 50, "en", "t"), (4, " ", "en", "t")])
    for source, some in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(d, t) for d, t, _, _ in odd_rows])):
        pieces = {}
        for r in packing.pack(source, 3 if source is docs else 2048).collect():
            assert len(r.text.split()) == r.n_words
            pieces.setdefault(r.doc_id, []).append((r.piece, r.text))
        for d, t in some:
            own = [x for _, x in sorted(pieces[d])]
            assert "".join(own) == (t or "") if sum(x == d for x, _ in some) == 1 else set(own) == {x or "" for y, x in some if y == d}


def test_many_equal_rows_use_several_shards(spark):
    docs = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "'five words are in here' as text", "'a' as source")
    found = packing.pack(docs, 64, 1024, texts=False).selectExpr("bin_id >> 24 as shard", "bin_id").groupBy("shard").count().collect()
    assert len(found) > 10 and max(r["count"] for r in found) < 3000 and sum(r["count"] for r in found) == 20_000


def jaccard_classes(rows):
    """The row of each group of texts whose sets of five words are four fifths alike that has the smallest id, by comparing all pairs."""
    sets = []
    for _, t, _, _ in rows:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def plain_redaction(text):
    """Spans of all rules merged and masked."""
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least)
    merged = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + "[secret]" + text[e:]
    return text


def test_pipeline_equals_plain_python(spark, make_docs, tmp_path):
    """The rows of run() against filters, all pairs, regular expressions and loops; the classifier's own score decides on quality."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ri", "sto", "mor", "wal", "qui") for b in ("ver", "ne", "ning", "ked", "et")]
    rows, labels = [], []
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(20, 160))
        bad = k % 4 == 0
        text = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words) if bad else " ".join(words)
        if k % 10 == 1:
            text += f"\npassword = hunter{k}xyz and more\n"
        rows.append((k, text, "en", "ab"[k % 2]))
        labels.append((k, int(not bad), 0))
    rows += [(200 + k, rows[k][1].replace("river", "riverx", 1), "en", "c") for k in range(1, 160, 8)] + [(300, None, None, None), (301, "", "en", "a")]
    make_docs(rows, ()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    score = quality.trained(spark, str(tmp_path)).scorer()
    good = [r for r in rows if score([r[1]])[0] >= quality.THRESHOLD]
    assert {r[0] for r in rows if r[0] < 160} - {r[0] for r in good} == set(range(0, 160, 4))
    first = jaccard_classes(good)
    once = [(d, plain_redaction(t), lang, s) for d, t, lang, s in good if d in first]
    assert len(once) < len(good)
    size = {}
    for _, t, _, s in once:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(s for s in size if s is not None) + ([None] if None in size else [])
    targets = fill(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = {}
    for r in found:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    texts = {d: (t or "", s) for d, t, _, s in once}
    assert all(r.text == texts[r.doc_id][0] and r.source == texts[r.doc_id][1] for r in found)
    for s in order:
        step = round(targets[s] / size[s] * mixing.UNIT) if size[s] else 0
        at = int(hashlib.md5(f"{mixing.SEED}:{s or ''}".encode()).hexdigest()[:6], 16)
        for n, d in sorted((len((t or "").split()), d) for d, t, _, x in once if x == s):
            copies = (at + step) // mixing.UNIT - at // mixing.UNIT
            assert times.get(d, 0) == copies
            at += step
    bins = {}
    for r in sorted(found, key=lambda r: r.bin_offset):
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():  # a bin's words are those of its pieces' texts, one after the other
        words = [w for r in own for w in r.text.split()]
        assert len(words) <= packing.CAPACITY and all(words[r.bin_offset : r.bin_offset + r.n_words] == r.text.split() for r in own)
        assert len({r.source for r in own if r.source is not None}) == sum(r.source is not None for r in own)


def test_pipeline_of_odd_and_of_no_rows(spark, odd, none, tmp_path):
    """Labels without rows reject nothing; columns come through all stages but the last; no documents give no rows."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in found} >= {1, 5} and all(len(r.text.split()) == r.n_words for r in found)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] > counts[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


def test_hot_pieces_are_dealt_alike_when_a_task_runs_again(spark):
    """The shard follows from the stored table, whatever partition a row is read in."""
    equal = spark.range(0, 400, numPartitions=1).selectExpr("1L as doc_id", "0L as piece", "'a' as source", "7L as cluster", "id as _place")
    deal = lambda df: sorted((r._place, r.shard) for r in packing._dealt(df, 40, 9).collect())
    once = deal(equal)
    assert len({s for _, s in once}) == 9
    for n in (3, 8):
        assert deal(equal.repartition(n)) == once == deal(equal.orderBy(F.rand(n)))
