import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import DATA, of_duck, of_spark
from glossmill.llm import alignment, fingerprints, ranking
from glossmill.llm.common import cut

# Fingerprints


def plain_next(rows):
    """(doc_id, n_chars, sha of the edited text) by sorting and slicing."""
    out = []
    for k, (doc, text) in enumerate(rows):
        n = len(text) // 4
        edited = text[: len(text) - n] + rows[(k + 1) % len(rows)][1][:n] if n else text
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.written(fingerprints.text_vector(text)), fingerprints.written(fingerprints.text_vector(edited))))
    return out


def digest(df):
    return [tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect()]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_next_documents_across_ranges(spark, make_docs, partitions):
    rng = random.Random(partitions)
    rows = [(k * 7 % 101, "\n".join(" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 6))) + rng.choice(["", "😀é"])) for k in range(101)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = digest(fingerprints.with_next(make_docs([(d, t, "en", "a") for d, t in rows]).repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(found) == sorted(plain_next(sorted(rows)))


def test_fingerprints_of_the_given_table(spark, duck):
    rows = duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()
    found = fingerprints.op11_fingerprints(spark, DATA)
    assert sorted(digest(found)) == sorted(plain_next(rows))
    r = found.selectExpr("avg(near_edited) e", "avg(near_next) n", "min(near_next) l", "max(near_edited) h").first()
    assert r.e > 0.65 and r.n < 0.1 and r.l >= 0 and r.h <= 1


def test_odd_documents(spark, odd, odd_rows, none):
    found = fingerprints.with_next(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(by_text[6]) == 1 and len(by_text[7]) == 2 and by_text[2] == by_text[3]
    assert {r.near_edited for r in found if r.n_chars < 4} == {1.0}
    assert fingerprints.with_next(none).count() == 0
    one = fingerprints.with_next(odd.filter("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.n_paragraphs == 1


def test_order_repeats_and_parts():
    v = fingerprints.text_vector
    a, b = "one line\nanother one", "and a third, with more words\n\nlast"
    same = lambda x, y: fingerprints.written(x) == fingerprints.written(y)
    assert same(v("b\na\nc"), v("c\nb\na")) and not same(v("a\na\nb"), v("a\nb\nb")) and not same(v("a"), v("a\n")) and not same(v(""), v("\n"))
    assert same(v(a) + v(b), v(f"{a}\n{b}")) and same(v(f"{a}\n{b}") - v(b), v(a))
    assert same(fingerprints.read(fingerprints.written(v(a))), v(a)) and same(v(a) - v(a), v(None))
    many = v("\n".join(["same words here"] * 70000))
    assert same(fingerprints.read(fingerprints.written(many)), many) and same(many - v("\n".join(["same words here"] * 69999)), v("same words here"))


def test_likeness_follows_the_shared_part():
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for part in (0, 0.25, 0.5, 0.9):
        head, n = words(int(2000 * part)), int(2000 * (1 - part))
        x, y = (fingerprints.text_vector(" ".join(head + words(n))) for _ in range(2))
        assert abs(fingerprints.vector_likeness(x, y) - part) < 0.12


def test_changes_keep_fingerprints_true(spark):
    prints = spark.createDataFrame([(1, "a b\nc"), (2, ""), (4, "stays")], "key long, text string")
    prints = prints.select("key", fingerprints.fingerprint("text").alias("fingerprint"))
    changes = [(1, "c", -1), (1, "new line", 1), (1, "new line", 1), (2, "x", 3), (2, "x", -1), (3, "first", 1), (None, "y", 1), (2, "kept", None), *[(1, "busy", 1)] * 500, *[(1, "busy", -1)] * 499]
    found = fingerprints.updated(prints, spark.createDataFrame(changes, "key long, paragraph string, times long").repartition(6))
    texts = {1: "a b\nnew line\nnew line\nbusy", 2: "x\nx", 3: "first", 4: "stays", None: "y"}
    assert {r.key: r.fingerprint for r in found.collect()} == {k: fingerprints.written(fingerprints.text_vector(t)) for k, t in texts.items()}
    sums = spark.createDataFrame([("a\nb", "b"), (None, "")], "x string, y string").select(fingerprints.fingerprint("x").alias("x"), fingerprints.fingerprint("y").alias("y"))
    assert [r[0] for r in sums.select(fingerprints.likeness(fingerprints.added(fingerprints.removed("x", "y"), "y"), "x")).collect()] == [1.0, 1.0]
    assert sums.filter(fingerprints.near(sums.x, sums.y, 0.9)).count() == 1
    assert fingerprints.with_fingerprint(spark.createDataFrame([("a",)], "text string")).columns == ["text", "fingerprint"]


# Alignment


def sides():
    read = lambda name: open(f"{alignment.FOLDER}/{name}", "rb").read()
    return alignment.byte_level(read(alignment.A)), alignment.pieces(read(alignment.B))


def plain_groups(a, b, text):
    """Groups by walking through both sides' tokens."""
    raw = b" " + (text or "").encode()
    x, y = a.encode([text or ""])[0], b.encode([text or ""])[0]
    if not text or b"".join(a.tokens[k] for k in x) != raw or b"".join(b.tokens[k] for k in y) != raw:
        return []
    groups, i, j = [], 0, 0
    while i < len(x):
        left, right = [x[i]], [y[j]]
        n, m = len(a.tokens[x[i]]), len(b.tokens[y[j]])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                left.append(x[i])
                n, i = n + len(a.tokens[x[i]]), i + 1
            else:
                right.append(y[j])
                m, j = m + len(b.tokens[y[j]]), j + 1
        groups.append((left, right))
    return groups


def plain_summaries(texts):
    a, b = sides()
    groups = [plain_groups(a, b, t) for t in texts]
    links = [Counter((i, j) for p, q in g for i in p for j in q) for g in groups]
    counts = Counter(pair for c in links for pair in c)
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for g, c in zip(groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


ODD_TEXTS = [None, "", " ", "x", "  two  blanks\n\n\tand a tab ", "<|endoftext|> and <s> and </s>", "▁ is a character", "naïve Übermut 東京 ก็ 😀‍👩", "a" * 3000, "\x00\x01", "ﬁ ligature", "1234567 12,5", "é\u0301 e\u0301"]


def test_ids_are_those_of_the_files_own_library(duck):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A}")
    own.encode_special_tokens = True
    a, b = sides()
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [t or "" for t in ODD_TEXTS] + [r[0] for r in duck.execute("select text from documents").fetchall()] + ["".join(f"a{c}b {c}1{c}!" for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    assert [list(x) for x in a.encode(texts)] == [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert len(a.tokens) == own.get_vocab_size() - 1 and len(b.tokens) == 32000  # but for the special token


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_alignment_equals_walking(spark, make_docs, duck, hot):
    texts = ODD_TEXTS + [r[0] for r in duck.execute("select text from documents where length(text) < 3000 order by doc_id limit 60").fetchall()]
    docs = make_docs([(k, t, "en", "a") for k, t in enumerate([*texts, texts[-1]])]).repartition(5)
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.summaries(docs, hot=hot).collect()}
    assert [found[k] for k in range(len(texts) + 1)] == plain_summaries([*texts, texts[-1]])


def test_alignment_of_the_given_table(spark, duck):
    rows = duck.execute("select doc_id, text from documents order by doc_id").fetchall()
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.op12_alignment(spark, DATA).collect()}
    assert [found[d] for d, _ in rows] == plain_summaries([t for _, t in rows])


def test_alignment_in_small_blocks(monkeypatch):
    a, b = sides()
    texts = ["some words of a text", "a" * 500, "", "x y z " * 40]
    whole = alignment.align(a, b, texts)
    monkeypatch.setattr(alignment, "BLOCK", 3)
    for x, y in zip(whole, alignment.align(a, b, texts), strict=True):
        assert x[:5] == y[:5] and np.array_equal(x[5], y[5]) and np.array_equal(x[6], y[6])
    assert [alignment.groups_of(a, b, t) for t in texts] == [plain_groups(a, b, t) for t in texts]


def test_odd_alignment(spark, odd, odd_rows, none):
    assert Counter(r.doc_id for r in alignment.summaries(odd).collect()) == Counter(r[0] for r in odd_rows)
    assert alignment.summaries(none).count() == 0
    pairs = alignment.links(odd).collect()
    assert {(r.a, r.n) for r in pairs if r.best} == {(r.a, max(x.n for x in pairs if x.a == r.a)) for r in pairs}


# Search


def plain_search(docs, items, best=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c, size in counted:
            m = 75 + 25 * size * n // total
            scores.append((sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t]), d))
        ranked = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:best]
        out += [(item, r, d, s) for r, (s, d) in enumerate(ranked, 1)]
    return out


def asked_of(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shard, queries, partitions", [(1, 1, 2), (60, 3, 7), (1 << 20, 256, 1)])
def test_search_equals_scoring_every_document(spark, make_docs, shard, queries, partitions):
    rng = random.Random(shard)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    docs = [(k * 13 % 157, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (5, None), (6, ""), (7, "-- ."), (8, "w1 " * 5000), (9, texts[1]), (9, texts[1])]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for k in range(12)] + [(3, "W1 w1 w2"), (None, "w3"), (50, None), (51, "nowhere")]
    index = cut(ranking.build(make_docs([(d, t, "en", "a") for d, t in docs]).repartition(partitions), shard))
    for best in (1, 20):
        assert asked_of(ranking.search(index, spark.createDataFrame(items, "item_id long, text string"), best, queries)) == sorted(plain_search(docs, items, best), key=repr)


def test_search_of_the_given_tables(spark, duck):
    assert of_spark(ranking.op13_search(spark, DATA)) == of_duck(duck, ranking.SQL)


def test_odd_search(spark, odd, none):
    items = spark.createDataFrame([(1, "fox"), (2, None)], "item_id long, text string")
    assert [(r.item_id, r.doc_id) for r in ranking.search(cut(ranking.build(odd)), items).collect()] == [(1, 1)]
    assert ranking.search(cut(ranking.build(none)), items).count() == 0
    assert ranking.search(cut(ranking.build(odd)), items.limit(0)).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 0, 16383, 16384], [(1 << 62) - 1, 1 << 56, 3], rng.integers(0, 1 << 40, 500)):
        assert ranking.unpacked_numbers(ranking.packed_numbers(np.array(values, np.int64))).tolist() == list(values)
