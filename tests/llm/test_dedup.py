import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F

from glossmill.llm import common
from glossmill.llm import components as cc
from glossmill.llm import embeddings, jaccard, simhash, substrings


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    found = {r.node: r.root for r in cc.components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert found == union({n for x in real for n in x}, real)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "one two", "a b c", "Ä B c\x1fd e " * 7, "w " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def near_fingerprints(seed, groups=30, size=8):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("crowd", [1, 256])
def test_links_connect_as_all_pairs_do(spark, crowd):
    fps = near_fingerprints(4) + [k << 40 for k in range(40)]
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), crowd).collect()
    found = union(fps, [(a % (1 << 64), b % (1 << 64)) for a, b in links])
    assert found == union(fps, pairs)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links)


def test_thresholds_sum_to_the_principle():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < np.linspace(0.05, 0.95, 64)
    bits[:, 1] = bits[:, 0]
    both = bits.T.astype(float) @ bits / 500
    for rows in (10, 10**5, 10**9, 10**13):
        groups = simhash.plan(rows, both)
        masks = [m for m, _ in groups]
        assert sum(m.bit_count() for m in masks) == sum(masks).bit_count()
        # any difference in two bits leaves some probed group within its threshold
        for a in range(64):
            for b in range(a, 64):
                apart = 1 << a | 1 << b
                assert any((apart & m).bit_count() <= t for m, t in groups)
    assert any(t > 0 for _, t in simhash.plan(10**13, both))
    together = next(g for g in simhash.group_bits(both, 3) if 0 in g)
    assert 1 in together


def test_near_duplicates_of_odd_rows(odd, none, make_docs):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 12
    assert {r.component_id for r in found if r.doc_id in (2, 3, 4)} == {2}
    assert [r.component_id for r in found if r.doc_id == 6] == [6, 6]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r.text or "" for r in odd.collect() if r.doc_id not in (3, 4)})
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == 0


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(seed):
    """Texts of 1 to 1,000 words with copies that share 60 to 99 % of the shingles; a phrase is in all, and some are in two."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    common = [f"c{k}" for k in range(12)]
    texts = [None, "", " \t", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f", *[" ".join(common[:k]) for k in (6, 7, 12)]]
    for size, copies in [(50, 12), (200, 12), (1000, 4)] * 3:
        base = [*common, *rng.choices(words, k=size)]
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.choice([1, 1, 1 + size // 100, 1 + size // 50])):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.2:
                base = copy
    return texts


def test_shingles_and_needed():
    rng = random.Random(3)
    for text in near_copies(1)[:40]:
        assert len(jaccard.shingles(text)) == len(shingle_set(text))
    for a, b in [rng.sample(near_copies(2), 2) for _ in range(20)]:
        assert len(np.intersect1d(jaccard.shingles(a), jaccard.shingles(b))) == len(shingle_set(a) & shingle_set(b))
    assert [jaccard.needed(n) for n in (1, 4, 5, 6, 10)] == [1, 4, 4, 5, 8]


def test_jaccard_groups_are_those_of_all_pairs(spark, make_docs):
    texts = near_copies(5)
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(sets[a], sets[b]) >= 0.8]
    levels = [similarity(sets[a], sets[b]) for a, b in pairs]
    assert min(levels) < 0.82 and 0.95 < max(x for x in levels if x < 1) and len(levels) > 100
    near = [(a, b) for a in range(len(texts)) for b in range(a) if 0.7 < similarity(sets[a], sets[b]) < 0.8]
    assert len(near) > 20
    found = jaccard.near_duplicates(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    root = {r.doc_id: r.root for r in found}
    least = {}
    for k in sorted(root):
        least.setdefault(root[k], k)
    assert {k: least[root[k]] for k in root} == union(range(len(texts)), pairs)


def test_jaccard_of_a_large_group_and_many_near_misses(spark, make_docs, monkeypatch):
    """300 near copies of one text, and 60 texts that share up to 70 % of its shingles with it and are nobody's copies."""
    monkeypatch.setattr(jaccard, "HELD", 4000)  # texts of a batch in several parts
    rng = random.Random(21)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    group = [" ".join([*base[: 5 + k % 100], f"g{k}", *base[6 + k % 100 :]]) for k in range(300)]
    misses = [" ".join([*base[: 70 + k % 25], *[f"m{k}x{rng.randrange(9000)}" for _ in range(40)]]) for k in range(60)]
    texts = [*group, *misses, None, "", *group[:40]]
    sets = [shingle_set(t or "") for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8]
    near = sum(0.5 < similarity(sets[a], sets[b]) < 0.8 for a in range(300) for b in range(300, 360))
    assert near > 3000
    found = jaccard.near_duplicates(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    root = {r.doc_id: r.root for r in found}
    least = {}
    for k in sorted(root):
        least.setdefault(root[k], k)
    assert {k: least[root[k]] for k in root} == union(range(len(texts)), [*pairs, (360, 361)])


def rows_of_joins(df):
    """Rows that the joins of df's plan make."""

    def walk(node):
        made = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
        children = node.children()
        return made + sum(walk(children.apply(k)) for k in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_sets_near_a_large_group_do_not_meet_all_of_it(spark, make_docs, monkeypatch):
    """A text, 250 copies with one or two of its 150 words changed, and 80 with four, which are nobody's copies."""
    rng = random.Random(31)
    base = [f"w{k}" for k in range(150)]

    def changed(nth, places):
        return " ".join(f"c{nth}x{k}" if k in places else w for k, w in enumerate(base))

    texts = [" ".join(base)] + [changed(k, rng.sample(range(150), 1 + k % 2)) for k in range(250)]
    texts += [changed(1000 + k, [5 + k % 20, 45 + k % 17, 85 + k % 13, 125 + k % 11]) for k in range(80)]
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 10_000 and sum(0.7 < similarity(a, b) < 0.8 for a in sets[:251] for b in sets[251:]) > 5000
    all_pairs, made = jaccard.all_pairs, []

    def counted(rooted):
        monkeypatch.setattr(jaccard, "all_pairs", all_pairs)
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            made.append(rows_of_joins(all_pairs(rooted)))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        return all_pairs(rooted)

    monkeypatch.setattr(jaccard, "all_pairs", counted)
    found = {r.doc_id: r.root for r in jaccard.near_duplicates(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    assert {k: least[found[k]] for k in found} == union(range(len(texts)), pairs)
    assert len(made) == 1 and made[0] < 5 * len(texts), made


def test_may_be_among_loses_no_key(spark):
    rows = spark.createDataFrame([(k, k * 7919 - 5000000) for k in range(2000)] + [(2000, None)], "id long, _word long")
    keys = rows.filter("id % 40 = 0").select("_word").union(spark.createDataFrame([(None,)], "k long"))
    for places in (1 << 24, 64, 1):
        found = {r.id: r._among for r in common.may_be_among(rows.withColumnRenamed("_word", "v"), F.col("v"), keys, places).collect()}
        assert len(found) == 2001 and all(found[k] for k in range(0, 2000, 40)) and not found[2000]
    passed = common.may_be_among(rows.withColumnRenamed("_word", "v"), F.col("v"), keys).filter("_among").count()
    assert passed == 50
    assert not common.may_be_among(rows.select("id"), F.col("id"), keys.limit(0)).filter("_among").count()


def test_near_dedup_stage_follows_similarity(spark, make_docs, odd, none):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:100], "changed", *b[101:]]) for b in base]  # 95 % of the shingles
    kept = corpus_pipeline.near_dedup(spark, make_docs([(k, t, "en", "a") for k, t in enumerate(texts)]), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    kept = corpus_pipeline.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r.text or "" for r in odd.collect() if r.doc_id not in (3, 4)})
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0


def removed(texts, match):
    data = [(t or "").encode() for t in texts]
    starts = {}
    for d, b in enumerate(data):
        for k in range(len(b) - match + 1):
            starts.setdefault(b[k : k + match], []).append((d, k))
    gone = [bytearray(len(b)) for b in data]
    for where in starts.values():
        if len(where) > 1:
            for d, k in where:
                gone[d][k : k + match] = b"\1" * match
    out = []
    for b, g in zip(data, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(k) for k in (60, 100, 300)]
    texts = [text(20) + shared[k % 3] + text(30) + shared[(k + 1) % 3][: 100 * k] for k in range(12)]
    copy = text(400)
    return [*texts, copy, copy, copy[:900] + "X" + copy[901:], "z" * 399, "z" * 400, "y" * 401, "ab" * 400, None, "", shared[2] + shared[2]]


@pytest.mark.parametrize("crowd", [1, 1000])
def test_substrings(make_docs, crowd):
    texts = passages()
    docs = make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(docs, crowd).collect()}
    assert found == dict(enumerate(removed(texts, substrings.MATCH)))


def shared_windows(rows, width=51):
    """For each (id, text), how many of its windows of words a row with another id or text has."""
    has = {}
    windows = [[tuple((t or "").encode().split()[k : k + width]) for k in range(len((t or "").encode().split()) - width + 1)] for _, t in rows]
    for row, own in zip(rows, windows, strict=True):
        for w in own:
            has.setdefault(w, set()).add(row)
    return [sum(len(has[w]) > 1 for w in own) for own in windows]


def test_passages_across_many_files(spark, tmp_path):
    """Passages of 51 to 120 words in documents of 32 input files; those of under 400 bytes are told by their words alone."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    planted = [text(n) for n in (50, 51, 51, 60, 70, 120)]
    rows = []
    for k in range(192):
        body = text(rng.randrange(0, 150))
        if k % 3 == 0:
            body = f"{body}\n{planted[k // 3 % 6]}\t{text(rng.randrange(0, 80))}"
        rows.append((k, body))
    rows += [(500, text(40) + " " + planted[5] + " " + planted[5]), (501, rows[7][1]), (501, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(32).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert docs.rdd.getNumPartitions() >= 8 and len(list((tmp_path / "docs").glob("*.parquet"))) == 32
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_shared_windows) for r in substrings.deduplicate(docs).collect())
    expected = [(d, *x, n) for (d, _), x, n in zip(rows, removed([t for _, t in rows], substrings.MATCH), shared_windows(rows), strict=True)]
    assert found == sorted(expected)
    told = {r[0]: (r[2], r[5]) for r in found}
    short = [k for k in range(3, 192, 18)]  # 51 words, under 400 bytes
    assert all(told[k][1] > 0 for k in short) and any(told[k][0] == 0 for k in short)
    assert sum(told[k][1] == 0 for k in range(0, 192, 18)) > 5  # 50 words, and by chance one more


def test_common_prefixes():
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 120)))
        order = substrings.suffix_array(data, len(data) + 1)
        depth = rng.choice([3, 8, 20, 400])
        expected = []
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            k = 0
            while k < depth and max(a, b) + k < len(data) and data[a + k] == data[b + k]:
                k += 1
            expected.append(k)
        assert substrings.common_prefixes(data, order, depth).tolist() == expected


def test_substrings_of_odd_rows(odd, odd_rows, none):
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(odd).collect()), key=repr)
    expected = removed([t for _, t, _, _ in odd_rows], substrings.MATCH)
    assert found == sorted(((d, *e) for (d, _, _, _), e in zip(odd_rows, expected, strict=True)), key=repr)
    assert substrings.deduplicate(none).count() == 0


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", b"banana", b"mississippi" * 9, bytes(range(256)) + bytes(range(255, -1, -1)), b"\xff\xffab\xff"])
def test_suffix_array(data):
    found = substrings.suffix_array(data, len(data) + 1).tolist()
    assert found == sorted(range(len(data)), key=lambda k: data[k:])


def test_every_string_is_in_one_context():
    rng = random.Random(1)
    for n in (0, 399, 400, 401, 5000):
        data = bytes(rng.randrange(97, 100) for _ in range(n))
        _, lo, length = substrings.contexts(data)
        owned = [p for a, k in zip(lo, length, strict=True) for p in range(a, a + k - substrings.MATCH + 1)]
        assert owned == list(range(max(0, n - substrings.MATCH + 1)))


def make_vectors(n=700):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 16))
    rows = []
    for k in range(n):
        v = centre[k % 60] + rng.normal(size=16) * rng.choice([0.02, 0.3, 1.0])
        rows.append((k, [float(x) for x in v], int(k % 3)))
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(4)] + [(n + 4, rows[5][1], 9), (n + 4, rows[5][1], 9)]
    inf, nan = float("inf"), float("nan")
    return rows + [(n + 10, None, 0), (n + 11, [], 0), (n + 12, [0.0] * 16, 0), (n + 13, [nan] + [1.0] * 15, 0), (n + 14, [inf] * 16, 0), (n + 15, [None] + [1.0] * 15, 0), (n + 16, rows[0][1], None), (n + 17, [1.0, 2.0], 0), (n + 18, [2.0, 4.0], 0), (None, rows[1][1], 1)]


def test_embeddings_equal_all_pairs(spark):
    rows = make_vectors()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, k1 string")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(docs, block=16, tile=2, fan=2).collect()), key=repr)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    assert len(links) > 500
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    root = union(range(len(rows)), links)
    least = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    expected = [(rows[k][0], count[k], least.get(root[k]), rows[k][0] == least.get(root[k])) for k in range(len(rows))]
    assert found == sorted(expected, key=repr)


def test_embeddings_of_several_tiles_at_the_default_sizes(spark):
    """26,000 vectors of one label: four tiles of 16 blocks of 512; groups of tiles of two, so that blocks move between tasks."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(9000, 12))
    x = centre[rng.integers(0, 9000, 26000)] + rng.normal(size=(26000, 12)) * rng.choice([0.05, 0.4], (26000, 1))
    vectors = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    count, links = np.zeros(len(x), int), []
    for at in range(0, len(x), 1000):
        i, j = np.nonzero(unit[at : at + 1000] @ unit.T >= 0.93)
        i += at
        count += np.bincount(i[i != j], minlength=len(x))
        links += [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b]
    root = union(range(len(x)), links)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors, square=2).collect()}
    assert len(links) > 10_000 and found == {k: (int(count[k]), root[k]) for k in range(len(x))}


def test_tiles_move_once_for_each_group_of_partners(spark):
    pairs = spark.createDataFrame([("1", 4, i, j) for i in range(40) for j in range(i, 40)], "label string, dims int, i long, j long")
    moved = embeddings.moves(pairs, 8)
    times = [r["count"] for r in moved.groupBy("tile").count().collect()]
    assert len(times) == 40 and max(times) <= 5
    tasks = {(r.gi, r.gj) for r in moved.collect()}
    assert tasks == {(a, b) for a in range(5) for b in range(a, 5)}


def test_principal_directions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 30)) * np.append(np.full(8, 6.0), np.full(22, 1.0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dims, directions = embeddings.principal(spark.createDataFrame([(v,) for v in x.tolist()], "embedding array<double>"))
    assert dims == 30 and np.allclose(directions.T @ directions, np.eye(8), atol=1e-9)
    best = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:8].sum()
    assert np.trace(directions.T @ np.cov(x.T) @ directions) > 0.99 * best


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_wide_vectors_meet_in_small_groups(spark):
    """At 1,536 dimensions a comparing task holds two tiles of 8,192 vectors, 201 MB, and finds what a product of all finds."""
    assert [embeddings.square_of(d) for d in (1, 64, 128, 768, 1024, 1536)] == [16, 16, 8, 1, 1, 1]
    assert all(2 * embeddings.square_of(d) * embeddings.TILE * embeddings.BLOCK * d * 8 <= 202e6 for d in (64, 100, 300, 768, 1024, 1536))
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 1536))
    x = np.vstack([base + rng.normal(size=base.shape) * s for s in (0.05, 0.1, 0.3, 0.35)])
    table = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.COSINE
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, block=4, tile=2).collect()}
    assert found == {k: int(near[k].sum()) - 1 for k in range(len(x))}


def test_contexts_that_share_no_half_are_not_sorted():
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    gram, left, right = noise(substrings.GRAM), noise(240), noise(240)
    anchor = substrings._mixed((lambda s, d: s[substrings.GRAM :][:1] - s[:1])(*substrings._rolling(substrings._BYTES[np.frombuffer(gram, np.uint8)])))[0]
    strings = [
        noise(320) + gram + noise(320),  # the anchor alone
        left + gram + noise(320), noise(80) + left + gram + noise(320),  # 320 bytes before and with it
        noise(320) + gram + right, noise(300) + gram + right[:170] + noise(60), noise(320) + gram + right[:150] + noise(100),
    ]
    anchors = np.full(len(strings), anchor, np.uint64)
    assert substrings.may_repeat(strings, anchors, np.ones(len(strings), np.int64)).tolist() == [False, True, True, True, True, False]
    assert substrings.may_repeat(strings, anchors, np.array([1, 2, 3, 1, 2, 1])).tolist() == [False, False, False, True, True, False]
    for _ in range(20):  # any context with a repeated string is among them
        middle = [left[rng.integers(0, 240) :] + gram + right[: rng.integers(0, 240)] for _ in range(6)]
        rows = [noise(rng.integers(0, 90)) + m + noise(rng.integers(0, 90)) for m in middle] + [noise(320) + gram + gram + noise(300)]
        may = substrings.may_repeat(rows, np.full(7, anchor, np.uint64), np.ones(7, np.int64))
        assert all(may[k] for k, starts in enumerate(substrings.repeated_starts(rows)) if len(starts))
