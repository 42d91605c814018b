import random
import zlib

import numpy as np
import pytest

from glossmill.llm import language, quality, toxicity
from glossmill.llm.training import labelled_sample

ODD = 12


def prose(rng, n, words=("river", "stone", "morning", "walked", "quiet", "table", "window", "letter", "carried", "evening")):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    """400 documents; a fifth is junk, another fifth toxic."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        text, good, toxic = prose(rng, 60), 1, 0
        if k % 5 == 0:
            text, good = " ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in text.split()), 0
        if k % 5 == 1:
            at = rng.randrange(40)
            words = text.split()
            text, toxic = " ".join(words[:at] + ["blockhead", "rotter"] + words[at:]), 1
        rows.append((k, text, "en", "a"))
        labels.append((k, good, toxic))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").collect()
    own = [r.predicted == r[label] for r in rows if held(r.doc_id)]
    assert own
    return sum(own) / len(own)


def test_sample_keeps_held_out_rows_away(corpus):
    docs, labels = corpus
    sample = labelled_sample(docs, labels, "quality", 30)
    assert [y for _, y in sample].count(0) == [y for _, y in sample].count(1) == 30
    unseen = {r.text for r in docs.collect() if held(r.doc_id)} - {r.text for r in docs.collect() if not held(r.doc_id)}
    assert not {t for t, _ in sample} & unseen


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    model = quality.fit(labelled_sample(docs, labels, "quality"))
    assert accuracy(quality.score_documents(docs, model), labels, "quality") > 0.97
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and 300 < kept.count() < 340


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.fit(labelled_sample(docs, labels, "toxic"))
    assert accuracy(toxicity.score_documents(docs, model), labels, "toxic") > 0.95


def small_net(rng, words=6):
    """A network over few words, whose names are letters, and their inputs."""
    names = ["abcdefgh"[k:] * 2 for k in range(words)]
    net = toxicity.initial(rng, words, 50)
    net["Ec"], net["Ew"] = rng.normal(0, 1, net["Ec"].shape), rng.normal(0, 1, net["Ew"].shape)
    owner, bucket = toxicity.grams_of(names)
    return names, net, toxicity.Words(np.arange(words), owner, bucket % 50)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    _, net, words = small_net(rng)
    at = rng.integers(0, 6, (3, 7))
    pool = np.ones((3, 7), bool)
    pool[:, :2] = False
    weight = rng.normal(0, 1, 3)

    def run(net):
        inputs, which = words.inputs(net)
        x = inputs[at]
        x[1, 5:] = 0
        return toxicity.forward(net, x, pool & (x[:, :, -1] > 0)), which

    (_, memo), which = run(net)
    found, d_x = toxicity.gradients(net, memo, weight)
    d_x[1, 5:] = 0
    d_inputs = np.zeros((6, toxicity.INPUTS))
    np.add.at(d_inputs, at.ravel(), d_x.reshape(-1, toxicity.INPUTS))
    found |= words.gradients(net, which, d_inputs)
    for name, values in net.items():
        places = [tuple(rng.integers(0, n) for n in values.shape)] + ([(int(words.bucket[3]), 1), (int(words.bucket[-1]), 2)] if name == "Ec" else [])
        for place in places:
            if name == "Ew" and place[0] == 0:
                continue  # unknown words stay at 0
            up, down = {k: v.copy() for k, v in net.items()}, {k: v.copy() for k, v in net.items()}
            up[name][place] += 1e-5
            down[name][place] -= 1e-5
            slope = (run(up)[0][0] @ weight - run(down)[0][0] @ weight) / 2e-5
            assert found[name][place] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def plain_states(net, given, words):
    """States of one text by loops over single words."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN
    out = {}
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        state, states = np.zeros(h), [None] * len(words)
        for t in order:
            if words[t]:
                g, r_ = given[d][words[t]].astype(float), state @ net[f"U{d}"].astype(float)
                z, r = sig(g[:h] + r_[:h]), sig(g[h : 2 * h] + r_[h : 2 * h])
                c = np.tanh(g[2 * h :] + r * r_[2 * h :])
                state = (1 - z) * c + z * state
            states[t] = state
        out[d] = states
    return np.array([np.concatenate([a, b]) for a, b in zip(out["f"], out["b"], strict=True)])


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 95, 96, 97, 300])
def test_every_window_is_scored_as_by_plain_loops(n):
    rng = np.random.default_rng(n)
    net = toxicity.single(toxicity.initial(rng))
    known = toxicity.KnownWords({}, net)
    text = [f"word{rng.integers(0, 40)}" for _ in range(n)]
    found, = toxicity.text_logits(net, known, [known.ids(text)])
    ids, given = [known[w] for w in text], known.tables()
    energy, value = [], []
    for at in range(0, max(n, 1), toxicity.BLOCK):
        low = at - toxicity.MARGIN
        block = [ids[k] if 0 <= k < n else 0 for k in range(low, at + toxicity.BLOCK + toxicity.MARGIN)]
        states = plain_states(net, given, block)[toxicity.MARGIN : -toxicity.MARGIN]
        e = np.tanh(states @ net["A"]) @ net["v"]
        energy += list(toxicity.REACH * np.tanh(e / toxicity.REACH))
        value += list(states @ net["u"])
    expected = []
    for at in range(max(1, n - toxicity.WINDOW + 1)):
        w = np.exp(energy[at : min(at + toxicity.WINDOW, max(n, 1))])
        expected.append(float(w @ value[at : at + len(w)] / w.sum() + net["c"][0]))
    assert found == pytest.approx(expected, abs=1e-4)


def test_grams_of_words():
    words = ["ab", "abc", "abcdefghij", "", "äöüß"]
    owner, bucket = toxicity.grams_of(words)
    count = [max(0, min(len(w), toxicity.PREFIX) - 2) + max(0, len(w) - toxicity.WITHIN + 1) for w in words]
    assert np.bincount(owner, minlength=5).tolist() == count
    for k, w in enumerate(words):
        assert sorted(bucket[owner == k]) == sorted(toxicity.grams_of([w])[1])


def test_a_toxic_passage_counts_at_every_offset(corpus):
    docs, labels = corpus
    model = toxicity.fit(labelled_sample(docs, labels, "toxic"))
    clean = prose(random.Random(8), 300).split()
    planted = [" ".join(clean[:at] + ["blockhead", "rotter"] + clean[at:]) for at in range(0, 300, 7)]
    assert (model.scores(planted) > 0.7).all() and model.scores([" ".join(clean)])[0] < 0.5
    one_by_one = [model.scores([t])[0] for t in planted]
    assert one_by_one == model.scores(planted).tolist()


def test_the_sample_is_bounded_in_bytes(corpus):
    docs, labels = corpus
    whole = labelled_sample(docs, labels, "quality")
    some = labelled_sample(docs, labels, "quality", size=20_000)
    assert 0 < len(some) < len(whole) and set(some) <= set(whole)
    assert all(sum(len(t.encode()) for t, y in some if y == label) <= 20_000 for label in (0, 1))


def test_quality_features_and_score_by_hand():
    import zstandard

    rng = random.Random(1)
    sample = [(prose(rng, 80), 1) if k % 2 else (" ".join(rng.choice(["$$$", "buy", "win!!"]) for _ in range(80)), 0) for k in range(80)]
    model = quality.fit(sample)
    score = model.scorer()
    for text in ["", "river stone $$$ buy " * 300, prose(rng, 20)]:
        data = text.encode()
        sizes = []
        for content in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(content)
            each = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(each.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE)))
        g, b = sizes
        x = ((b - g) / (b + g), np.log((b + g) / (2 * len(data)))) if data else (0.0, 0.0)
        logit = x[0] * model.weights[0] + x[1] * model.weights[1] + model.weights[2]
        assert score([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(module, corpus, odd, none):
    docs, labels = corpus
    label = "quality" if module is quality else "toxic"
    model = module.fit(labelled_sample(docs, labels, label, 100))
    scored = module.score_documents(odd, model).collect()
    assert len(scored) == ODD and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 6}) == 1
    assert module.score_documents(none, model).count() == 0
    unlabelled = module.fit(labelled_sample(docs, labels.filter("false"), label))
    assert {r.score for r in module.score_documents(odd, unlabelled).collect()} == {0.5}


@pytest.fixture(scope="module")
def languages(make_docs):
    rng = random.Random(5)
    vocabulary = {"en": ("the", "house", "with", "morning", "thought"), "de": ("der", "schön", "über", "straße", "nicht"), "fr": ("très", "maison", "avec", "être", "où")}
    return make_docs([(k, prose(rng, 40, vocabulary[lang]), lang, "s") for k, lang in enumerate(("en", "de", "fr") * 40)])


def test_language_on_held_out_rows(languages):
    model = language.fit(languages)
    assert model.languages == ("de", "en", "fr")
    wrong = [r for r in language.identify(languages, model).join(languages.select("doc_id", "lang"), "doc_id").collect() if r.lang != r.lang_pred]
    assert not wrong


def test_language_shares(languages):
    model = language.fit(languages)
    (first, share), = model.scores(["the house with morning thought " * 30 + "der schön über straße " * 10])
    assert first == "en" and 0.6 < share < 0.9


def test_language_counts_equal_those_of_single_trigrams():
    text = "Schön\x00ist 12 die  STRASSE,\nnicht?"
    whole = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    one_by_one = [int(language.trigrams([whole[i : i + 3]])[1][0]) for i in range(len(whole) - 2) if whole[i + 1] != " "]
    for step in (1, 2, 7, 1000):
        assert language.counted(text, step).tolist() == np.bincount(one_by_one, minlength=language.BUCKETS).tolist()
    number, bucket = language.trigrams([language.padded(text), language.padded("\x00"), language.padded(text)])
    assert set(number.tolist()) == {0, 2} and sorted(bucket[number == 0]) == sorted(bucket[number == 2]) == sorted(one_by_one)


def test_language_of_very_long_texts(languages, monkeypatch):
    model = language.fit(languages)
    texts = ["the house \x00 with morning", None, "der schön über straße nicht " * 40, "12", "avec très maison"]
    whole = model.scores(texts)
    monkeypatch.setattr(language, "STEP", 50)
    assert [w[0] for w in whole] == ["en", "und", "de", "und", "fr"] and model.scores(texts) == whole


def test_language_mixture_is_the_likelihoods_maximum():
    rng = np.random.default_rng(1)
    chances = rng.dirichlet(np.ones(50), 2)
    counts = rng.multinomial(2000, 0.3 * chances[0] + 0.7 * chances[1]).astype(float)
    shares, _ = language.mixture(chances, counts, np.array([0.5, 0.5]))
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([counts @ np.log(g * chances[0] + (1 - g) * chances[1]) for g in grid])]
    assert shares[0] == pytest.approx(best, abs=0.01)


def test_selected_languages_are_the_best_of_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(2)
    chances = rng.dirichlet(np.full(60, 0.3), 4) * 0.99 + 0.01 / 60
    for mix in ([1, 0, 0, 0], [0, 0.6, 0.4, 0], [0.4, 0, 0.3, 0.3], [0.25] * 4):
        counts = rng.multinomial(3000, np.array(mix) @ chances).astype(float)
        price = language.PENALTY * 0.5 * np.log(counts.sum())
        reached = {}
        for n in range(1, 5):
            for some in combinations(range(4), n):
                shares, likelihood = language.mixture(chances[list(some)], counts, np.full(n, 1 / n))
                reached[some] = (likelihood - price * (n - 1), shares)
        best = max(reached, key=lambda some: reached[some][0])
        found = language.select_languages(chances, counts)
        assert tuple(np.flatnonzero(found).tolist()) == best == tuple(np.flatnonzero(mix).tolist())
        assert found[list(best)] == pytest.approx(reached[best][1], abs=0.01)


def test_every_language_is_fitted(make_docs):
    """250 languages, each with words of its own; the last one has the fewest rows."""
    rng = random.Random(7)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñ") for _ in range(6)) for _ in range(8)] for k in range(250)}
    rows = [(k * 10 + n, " ".join(rng.choices(words[lang], k=40)), lang, "s") for k, lang in enumerate(sorted(words)) for n in range(2 if k == 249 else 4)]
    docs = make_docs(rows)
    model = language.fit(docs)
    kept = {r.lang for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert set(model.languages) == kept and len(kept) > 240
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(found[d] == lang for d, _, lang, _ in rows if lang in kept)


def test_language_of_odd_rows(languages, odd, none):
    model = language.fit(languages)
    found = language.identify(odd, model).collect()
    assert len(found) == ODD
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4, (1 << 60) + 2))
    assert all(r.lang_pred != "und" for r in found if r.doc_id in (1, 5, 6))
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
