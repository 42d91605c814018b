"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word comes in as its own embedding and as those of its character n-grams, their mean and their maximum; all embeddings are
trained through the network. The states of both directions are pooled over every window of words, at every start, and a text is
as toxic as its worst windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from glossmill.llm.common import crc_mod, table
from glossmill.llm.training import ROWS_PER_LABEL, fit_logistic, labelled_sample, sigmoid

#: Words of a window. A state depends on the words of its block: BLOCK words, and MARGIN more on either side.
WINDOW, BLOCK, MARGIN = 32, 96, 16
HIDDEN = 6
#: Numbers of an embedding; a word's inputs are its own, the mean and the maximum of its n-grams', and a 1.
WIDTH = 4
INPUTS = 3 * WIDTH + 1
THRESHOLD = 0.7
#: Share of toxic documents that scores are calibrated for; the labels' own share varies from corpus to corpus.
PRIOR = 0.25
#: Longest n-gram of characters at a word's start, and length of those within; buckets that n-grams are hashed into.
PREFIX, WITHIN = 8, 5
BUCKETS = 1 << 16
#: Documents of the sample that a word or n-gram must be in for a start other than 0.
LEAST = 3
#: Energies of the attention lie between -REACH and REACH, so that sums over windows can be taken as differences.
REACH = 8.0
#: Words whose inputs a worker keeps; blocks that run through the network at once, in whole lots of ROWS.
KEPT_WORDS = 200_000
AT_ONCE = 1024
ROWS = 64
#: Rounds of choosing each text's worst window, steps of training on them, and the rates for the network and the embeddings.
ROUNDS, STEPS, BATCH, RATE, RATE_E = 4, 60, 192, 0.02, 0.002
WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of_text(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every character n-gram: starts of 3 to PREFIX characters, and all of WITHIN characters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    first = ends - lengths
    n = len(codes)
    up, down = _powers(1 << max(12, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1)) * up[:n], out=sums[1:])
    owners, buckets = [], []

    def add(owner: np.ndarray, at: np.ndarray, k: int, kind: int) -> None:
        owners.append(owner)
        buckets.append(_mixed((sums[at + k] - sums[at]) * down[at] + np.uint64(kind)) % np.uint64(BUCKETS))

    for k in range(3, PREFIX + 1):
        long = np.flatnonzero(lengths >= k)
        add(long, first[long], k, k)
    owner = np.repeat(np.arange(len(words)), lengths)
    inside = np.flatnonzero(np.arange(n) + WITHIN <= ends[owner])
    add(owner[inside], inside, WITHIN, 0)
    owner, bucket = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


@dataclass
class Words:
    """Distinct words: their rows in the embedding of words, 0 for unknown ones, and their n-grams."""

    row: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    starts: np.ndarray = field(init=False)
    some: np.ndarray = field(init=False)
    times: np.ndarray = field(init=False)

    def __post_init__(self):
        self.some, self.starts, self.times = np.unique(self.owner, return_index=True, return_counts=True)

    def inputs(self, net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of each word, and which n-gram each maximum is from."""
        out = np.zeros((len(self.row), INPUTS), net["Ew"].dtype)
        out[:, :WIDTH] = net["Ew"][self.row]
        out[:, -1] = 1
        which = np.zeros((len(self.some), WIDTH), np.int64)
        if len(self.some):
            each = net["Ec"][self.bucket]
            out[self.some, WIDTH : 2 * WIDTH] = np.add.reduceat(each, self.starts) / self.times[:, None]
            most = np.maximum.reduceat(each, self.starts)
            out[self.some, 2 * WIDTH : 3 * WIDTH] = most
            hit = each == np.repeat(most, self.times, axis=0)
            place = np.where(hit, np.arange(len(each))[:, None], len(each))
            which = np.minimum.reduceat(place, self.starts)
        return out, which

    def gradients(self, net: dict[str, np.ndarray], which: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of both embeddings, given those of the inputs."""
        words = _sums(self.row, d[:, :WIDTH], len(net["Ew"]))
        words[0] = 0
        grams = np.zeros_like(net["Ec"])
        if len(self.some):
            mean = d[self.some, WIDTH : 2 * WIDTH] / self.times[:, None]
            grams += _sums(self.bucket, np.repeat(mean, self.times, axis=0), len(grams))
            for k in range(WIDTH):
                grams[:, k] += np.bincount(self.bucket[which[:, k]], d[self.some, 2 * WIDTH + k], len(grams))
        return {"Ew": words, "Ec": grams}


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to the same place, of n."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1)


def initial(rng: np.random.Generator, words: int = 1, buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """Weights of both directions, of the attention and of the output, and the embeddings of words and of n-grams."""
    h = HIDDEN
    net = {}
    for d in "fb":
        net[f"W{d}"] = rng.normal(0, 0.5, (INPUTS, 3 * h))
        net[f"U{d}"] = rng.normal(0, 0.3, (h, 3 * h))
        net[f"b{d}"] = np.zeros(3 * h)
    net |= {"A": rng.normal(0, 0.5, (2 * h, h)), "v": rng.normal(0, 0.5, h), "u": rng.normal(0, 0.5, 2 * h), "c": np.zeros(1)}
    net |= {"Ew": rng.normal(0, 0.02, (words, WIDTH)), "Ec": rng.normal(0, 0.02, (buckets, WIDTH))}
    net["Ew"][0] = 0
    return net


def _sig(x: np.ndarray) -> np.ndarray:
    y = np.tanh(x * x.dtype.type(0.5))
    y += 1
    y *= 0.5
    return y


def _run(net: dict[str, np.ndarray], d: str, given: np.ndarray, real: np.ndarray, keep: bool = False):
    """States (steps x blocks x HIDDEN) of one direction from its projected inputs; padded steps leave the state as it is."""
    steps, h = range(len(given)) if d == "f" else range(len(given) - 1, -1, -1), HIDDEN
    state = np.zeros((given.shape[1], h), given.dtype)
    out, memo = np.empty((*given.shape[:2], h), given.dtype), {}
    full = real.all((1, 2))
    for t in steps:
        recurrent = state @ net[f"U{d}"]
        gates = _sig(given[t, :, : 2 * h] + recurrent[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = np.tanh(given[t, :, 2 * h :] + r * recurrent[:, 2 * h :])
        new = c + z * (state - c)
        if not full[t]:
            new = np.where(real[t], new, state)
        if keep:
            memo[t] = (state, z, r, c, recurrent[:, 2 * h :])
        out[t] = state = new
    return out, memo


def _attend(net: dict[str, np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and energy of each state."""
    hidden = np.tanh(states @ net["A"])
    return hidden, REACH * np.tanh(hidden @ net["v"] / states.dtype.type(REACH))


def forward(net: dict[str, np.ndarray], x: np.ndarray, pool: np.ndarray):
    """Logit of each window, and what gradients() needs. x (windows x steps x INPUTS) has its margins; `pool` tells which steps are pooled."""
    x = np.ascontiguousarray(x.transpose(1, 0, 2))
    real, pool = x[:, :, -1:] > 0, pool.T
    (ahead, memo_f), (back, memo_b) = (_run(net, d, x @ net[f"W{d}"] + net[f"b{d}"], real, True) for d in "fb")
    states = np.concatenate([ahead, back], axis=2)
    hidden, energy = _attend(net, states)
    weight = np.where(pool, np.exp(energy), 0)
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ net["u"] + net["c"][0], (x, real, memo_f, memo_b, states, hidden, energy, weight, pooled)


def gradients(net: dict[str, np.ndarray], memo, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the summed loss by the weights and by the inputs, given its derivative by each window's logit."""
    x, real, memo_f, memo_b, states, hidden, energy, weight, pooled = memo
    h = HIDDEN
    out = {"u": pooled.T @ error, "c": np.array([error.sum()])}
    d_pooled = error[:, None] * net["u"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0)) * (1 - (energy / REACH) ** 2)
    out["v"] = np.einsum("tn,tnh->h", d_energy, hidden)
    d_hidden = d_energy[:, :, None] * net["v"] * (1 - hidden**2)
    out["A"] = np.einsum("tni,tnh->ih", states, d_hidden)
    d_states = d_states + d_hidden @ net["A"].T
    d_x = np.zeros_like(x)
    for d, memo_d, part in (("f", memo_f, d_states[:, :, :h]), ("b", memo_b, d_states[:, :, h:])):
        w, u, b = np.zeros_like(net[f"W{d}"]), np.zeros_like(net[f"U{d}"]), np.zeros_like(net[f"b{d}"])
        carry = np.zeros_like(part[0])
        for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
            state, z, r, c, candidate = memo_d[t]
            total = part[t] + carry
            live = total * real[t]
            d_c = live * (1 - z) * (1 - c**2)
            d_z = live * (state - c) * z * (1 - z)
            d_r = d_c * candidate * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_c], axis=1)
            d_rec = np.concatenate([d_z, d_r, d_c * r], axis=1)
            w += x[t].T @ d_in
            b += d_in.sum(0)
            u += state.T @ d_rec
            d_x[t] += d_in @ net[f"W{d}"].T
            carry = np.where(real[t], live * z + d_rec @ net[f"U{d}"].T, total)
        out |= {f"W{d}": w, f"U{d}": u, f"b{d}": b}
    return out, d_x.transpose(1, 0, 2)


def blocks_of(ids: np.ndarray) -> np.ndarray:
    """A text's words in blocks with their margins; number 0 is no word. A text without words has one block."""
    n = max(1, -(-len(ids) // BLOCK))
    padded = np.zeros(n * BLOCK + 2 * MARGIN, np.int32)
    padded[MARGIN : MARGIN + len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, BLOCK + 2 * MARGIN)[::BLOCK]


def word_values(net: dict[str, np.ndarray], given: dict[str, np.ndarray], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energy of each word of the blocks, without their margins, and what it adds to a window's logit.

    given has the projected inputs of each word for both directions. Blocks run in whole lots of ROWS, so that the products of a
    row are summed alike wherever it stands.
    """
    n = len(blocks)
    whole = np.concatenate([blocks, np.zeros((-n % ROWS, blocks.shape[1]), blocks.dtype)])
    energies, values = [], []
    for i in range(0, len(whole), AT_ONCE):
        at = np.ascontiguousarray(whole[i : i + AT_ONCE].T)
        real = at[:, :, None] > 0
        states = np.concatenate([_run(net, d, given[d][at], real)[0][MARGIN:-MARGIN] for d in "fb"], axis=2)
        energies.append(_attend(net, states)[1].T)
        values.append((states @ net["u"]).T)
    return np.concatenate(energies)[:n], np.concatenate(values)[:n]


def window_logits(energies: np.ndarray, values: np.ndarray, bias: float) -> np.ndarray:
    """Logit of the window at every start, from the energies and values of a text's words; a shorter text is one window."""
    weight = np.exp(energies.astype(np.float64))
    sums = np.concatenate([[0.0], np.cumsum(weight)]), np.concatenate([[0.0], np.cumsum(weight * values)])
    span = min(WINDOW, len(weight))
    return (sums[1][span:] - sums[1][:-span]) / (sums[0][span:] - sums[0][:-span]) + bias


def summary(own: np.ndarray) -> tuple[float, float, float]:
    """What a text's score is made of: its worst window, the mean of its three worst stretches of WINDOW starts, and the log of their number."""
    stretches = np.sort(np.maximum.reduceat(own, np.arange(0, len(own), WINDOW)))
    return float(stretches[-1]), float(stretches[-3:].mean()), log(len(stretches))


class KnownWords(dict):
    """Number of each word, from 1, in growing tables of projected inputs; 0 is no word."""

    def __init__(self, vocabulary: dict[str, int], net: dict[str, np.ndarray]):
        super().__init__()
        self.vocabulary, self.net = vocabulary, net
        self.new: list[str] = []
        self.given = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self) + 1
        return n

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def tables(self) -> dict[str, np.ndarray]:
        """The tables, with the rows of the words that came in since the last call."""
        if self.new:
            rows = np.fromiter((self.vocabulary.get(w, 0) for w in self.new), np.int64, len(self.new))
            x, _ = Words(rows, *grams_of(self.new)).inputs(self.net)
            for d in "fb":  # sums over a row's inputs in one order, whatever the number of rows
                added = np.tile(self.net[f"b{d}"], (len(x), 1))
                for k in range(INPUTS):
                    added += x[:, k : k + 1] * self.net[f"W{d}"][k]
                self.given[d] = np.concatenate([self.given[d], added.astype(np.float32)])
            self.new = []
        return self.given

    def forget(self) -> None:
        self.clear()
        self.new = []
        self.given = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}


def text_logits(net: dict[str, np.ndarray], known: KnownWords, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Logits of all windows of each text, given as numbers of words."""
    blocks = [blocks_of(ids) for ids in texts]
    energies, values = word_values(net, known.tables(), np.concatenate(blocks))
    out, at = [], 0
    for ids, own in zip(texts, blocks, strict=True):
        n = max(1, len(ids))
        e, v = energies[at : at + len(own)].ravel()[:n], values[at : at + len(own)].ravel()[:n]
        out.append(window_logits(e, v, float(net["c"][0])))
        at += len(own)
    return out


def lots(net: dict[str, np.ndarray], known: KnownWords, documents: Iterable[list[str]]) -> Iterator[np.ndarray]:
    """Logits of all windows of each document in turn; a lot of documents runs at once, and the words of many are forgotten."""
    held: list[np.ndarray] = []
    size = 0
    for words in documents:
        held.append(known.ids(words))
        size += len(words) + BLOCK
        if size >= AT_ONCE * BLOCK or len(known) > KEPT_WORDS:
            yield from text_logits(net, known, held)
            held, size = [], 0
            if len(known) > KEPT_WORDS:
                known.forget()
    if held:
        yield from text_logits(net, known, held)


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: dict[str, int]
    net: dict[str, np.ndarray]
    weights: tuple[float, ...]

    def scores(self, texts: list[str | None], known: KnownWords | None = None) -> np.ndarray:
        known = KnownWords(self.vocabulary, self.net) if known is None else known
        w = np.array(self.weights)
        found = np.array([summary(x) for x in lots(self.net, known, map(words_of_text, texts))]).reshape(-1, 3)
        return np.round(sigmoid((found * w[:-1]).sum(1) + w[-1]), 6)


def _odds(yes: np.ndarray, no: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How much more often in toxic documents than in others: log-odds, shrunk by support; 0 for what speaks for neither."""
    x = (np.log((yes + 0.5) / (toxic + 1)) - np.log((no + 0.5) / (clean + 1))) * yes / (yes + 4)
    return np.where((yes >= LEAST) & (x > 0.3), np.minimum(x, 6.0) / 3, 0.0)


def starting_point(documents: list[list[str]], labels: np.ndarray, rng: np.random.Generator) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """The vocabulary and an untrained network; the first number of each embedding is the log-odds of its word or n-gram."""
    counts, grams = (Counter(), Counter()), np.zeros((2, BUCKETS))
    for words, y in zip(documents, labels.astype(int).tolist(), strict=True):
        own = sorted(set(words))
        counts[y].update(own)
        if own:
            grams[y][np.unique(grams_of(own)[1])] += 1
    kept = sorted(w for w in counts[0].keys() | counts[1].keys() if counts[0][w] + counts[1][w] >= LEAST)
    toxic = int(labels.sum())
    net = initial(rng, len(kept) + 1)
    yes, no = (np.array([counts[y][w] for w in kept], dtype=float) for y in (1, 0))
    net["Ew"][1:, 0] = _odds(yes, no, toxic, len(labels) - toxic)
    net["Ec"][:, 0] = _odds(grams[1], grams[0], toxic, len(labels) - toxic)
    return {w: k for k, w in enumerate(kept, 1)}, net


def _train(vocabulary: dict[str, int], net: dict[str, np.ndarray], documents: list[list[str]], labels: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Each round picks every text's worst window by the network so far, and trains on these with Adam."""
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    slow, fast = ({k: np.zeros_like(v) for k, v in net.items()} for _ in "sf")
    pool = np.zeros(WINDOW + 2 * MARGIN, bool)
    pool[MARGIN:-MARGIN] = True
    step = 0
    for _ in range(ROUNDS):
        worst = []
        for words, own in zip(documents, lots(single(net), KnownWords(vocabulary, single(net)), documents), strict=True):
            at = int(np.argmax(own))
            worst.append(["" if k < 0 or k >= len(words) else words[k] for k in range(at - MARGIN, at + WINDOW + MARGIN)])
        names = ["", *sorted({w for window in worst for w in window if w})]
        number = {w: k for k, w in enumerate(names)}
        at = np.array([[number[w] for w in window] for window in worst], dtype=np.int64)
        rows = np.array([vocabulary.get(w, 0) for w in names])
        owner, bucket = grams_of(names)
        edges = np.searchsorted(owner, np.arange(len(names) + 1))
        for _ in range(STEPS):
            step += 1
            chosen = rng.choice(len(documents), min(BATCH, len(documents)), replace=False)
            used, place = np.unique(at[chosen], return_inverse=True)
            times = edges[used + 1] - edges[used]
            mine = np.arange(times.sum()) + np.repeat(edges[used] - np.cumsum(times) + times, times)
            words = Words(rows[used], np.repeat(np.arange(len(used)), times), bucket[mine])
            inputs, which = words.inputs(net)
            inputs[used == 0] = 0
            x = inputs[place.reshape(len(chosen), -1)]
            pooled = (x[:, :, -1] > 0) & pool
            pooled[:, MARGIN] = True
            logit, memo = forward(net, x, pooled)
            found, d_x = gradients(net, memo, (_sig(logit) - labels[chosen]) * weight[chosen] / len(chosen))
            d_inputs = _sums(place.ravel(), d_x.reshape(-1, INPUTS), len(used))
            d_inputs[used == 0] = 0
            for name, g in (found | words.gradients(net, which, d_inputs)).items():
                slow[name] += 0.1 * (g - slow[name])
                fast[name] += 0.01 * (g * g - fast[name])
                rate = RATE_E if name in ("Ew", "Ec") else RATE
                net[name] = net[name] - rate * (slow[name] / (1 - 0.9**step)) / (np.sqrt(fast[name] / (1 - 0.99**step)) + 1e-6)
    return net


def single(net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float32) for k, v in net.items()}


def fit(sample: list[tuple[str, int]], seed: int = 7) -> ToxicityModel:
    """Trains on whole labelled texts, of which only the documents' labels are known.

    Three quarters of the sample train the network and the embeddings; the others, whose words it has not seen, calibrate the
    score, as if PRIOR of all documents were toxic. Without both labels in both parts the score is the labels' share.
    """
    documents, labels = [words_of_text(t) for t, _ in sample], np.array([y for _, y in sample], dtype=np.float64)
    rng = np.random.default_rng(seed)
    rest = np.arange(len(sample)) % 4 == 3
    if len(set(labels[rest].tolist())) < 2 or len(set(labels[~rest].tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return ToxicityModel({}, single(initial(rng)), (0.0, 0.0, 0.0, log(share / (1 - share))))
    own = [d for d, r in zip(documents, rest, strict=True) if not r]
    vocabulary, net = starting_point(own, labels[~rest], rng)
    net = single(_train(vocabulary, net, own, labels[~rest], rng))
    unseen = (d for d, r in zip(documents, rest, strict=True) if r)
    features = np.array([summary(x) for x in lots(net, KnownWords(vocabulary, net), unseen)])
    weights = fit_logistic(features, labels[rest], 1e-3)
    share = labels[rest].mean()
    weights[-1] += log((1 - share) / share) - log((1 - PRIOR) / PRIOR)
    return ToxicityModel(vocabulary, net, tuple(weights))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per input row, for whole texts.

    The score is from 0 to 1; null and empty texts are one window without words. Equal rows score alike; an empty table gives no
    rows.
    """

    @pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = KnownWords(model.vocabulary, model.net)
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist(), known))

    return docs.select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str, rows: int = ROWS_PER_LABEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", rows))
    return score_documents(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
