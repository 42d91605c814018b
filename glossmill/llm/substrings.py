"""Exact substring deduplication with two-stage suffix sorting.

Every string of MATCH bytes has a smallest k-gram by hash, its anchor; equal strings have equal anchors at the same place. So
each document is dealt into contexts, the strings that one anchor stands for, and only contexts that share an anchor can hold
equal strings. Contexts that are equal as a whole need no more; the others are sorted as suffixes, anchor by anchor, and the
common prefixes of neighbours tell which strings repeat.

Passages are found beside them in the same way, with words for bytes: windows of PASSAGE words that another document has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import cut, salted_semi, settled, table

MATCH = 400
GRAM = 80
#: k-grams of a string of MATCH bytes.
SPAN = MATCH - GRAM + 1
#: Bytes of contexts that are suffix-sorted at once, and contexts of an anchor above which they are not.
BLOCK = 1 << 18
CROWD = 1000
#: No byte of UTF-8.
END = b"\xff"
#: Words of a passage that counts as shared, and of the runs of words whose hashes its anchor is chosen from.
PASSAGE = 51
RUN = 8
_PLACE = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: 1 for the bytes of words, 0 for the six blanks.
_IN_WORD = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)], np.int8)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _rolling(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run of units follows, and the factors that take a run's place out of it."""
    n = len(units)
    up, down = _powers(1 << max(12, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(units * up[:n], out=sums[1:])
    return sums, down


def _anchored(hashes: np.ndarray, span: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows 0 .. count-1 of `span` hashes each: anchor hash, first window and number of windows for each run with the same least hash."""
    m = len(hashes)
    place = np.uint64((1 << _PLACE) - 1)
    keys = np.full(-(-m // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:m] = (hashes & ~place) | np.arange(m, dtype=np.uint64)
    rows = keys.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:count], ahead[span - 1 : span - 1 + count]) & place).astype(np.int64)
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return hashes[anchor[starts]], starts, np.diff(np.append(starts, count))


def contexts(data: bytes, rolled: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first byte and length of each context; every string of MATCH bytes is in just one of them."""
    n = len(data)
    if n < MATCH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, down = rolled or _rolling(_BYTES[np.frombuffer(data, np.uint8)])
    hashes = _mixed((sums[GRAM:] - sums[: n + 1 - GRAM]) * down[: n + 1 - GRAM])
    h, starts, times = _anchored(hashes, SPAN, n - MATCH + 1)
    return h, starts, times + MATCH - 1


def passage_windows(data: bytes, rolled: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and factors over the hashes of a text's words, and so of its windows."""
    codes = np.frombuffer(data, np.uint8)
    sums, down = rolled or _rolling(_BYTES[codes])
    edges = np.flatnonzero(np.diff(_IN_WORD[codes], prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    return _rolling(_mixed((sums[ends] - sums[starts]) * down[starts]))


def word_contexts(data: bytes, rolled: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, digest, first window and number of windows of PASSAGE words for each context of words."""
    sums, down = passage_windows(data, rolled)
    n = len(sums) - 1
    if n < PASSAGE:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _mixed((sums[RUN:] - sums[: n + 1 - RUN]) * down[: n + 1 - RUN])
    h, starts, times = _anchored(hashes, PASSAGE - RUN + 1, n - PASSAGE + 1)
    return h, _mixed((sums[starts + times + PASSAGE - 1] - sums[starts]) * down[starts] + times.astype(np.uint64)), starts, times


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of bytes, with a digest of each, and of words (`passage`), where lo and len count windows and t is the document's key."""
    digest = xxhash.xxh3_64_intdigest

    def told() -> pd.DataFrame:
        names = ("passage", "h", "c", "doc_id", "t", "lo", "len")
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)})

    for batch in batches:
        size, parts = 0, []
        for doc_id, t, key, text in zip(batch["doc_id"], batch["t"], batch["k"], batch["text"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            rolled = _rolling(_BYTES[np.frombuffer(data, np.uint8)])
            h, lo, length = contexts(data, rolled)
            if len(h):
                own = np.array([digest(data[s : s + k]) for s, k in zip(lo.tolist(), length.tolist(), strict=True)], dtype=np.uint64)
                parts.append((np.zeros(len(h), bool), h.view(np.int64), own.view(np.int64), np.full(len(h), doc_id, object), np.full(len(h), t, np.int64), lo, length))
            size += len(h)
            h, own, lo, length = word_contexts(data, rolled)
            if len(h):
                parts.append((np.ones(len(h), bool), h.view(np.int64), own.view(np.int64), np.full(len(h), None, object), np.full(len(h), key, np.int64), lo, length))
            size += len(h)
            if size >= 100_000:
                yield told()
                size, parts = 0, []
        if parts:
            yield told()


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashes of the windows that are asked for, each with the least and the greatest document known to have it."""
    for batch in batches:
        parts = []
        for k, text, asked in zip(batch["k"], batch["text"], batch["asked"], strict=True):
            sums, down = passage_windows(text.encode("utf-8", "surrogatepass"))
            at, other = (np.array([x[name] for x in asked], np.int64) for name in ("at", "other"))
            times = at & 63
            places = np.arange(times.sum()) + np.repeat((at >> 6) - np.cumsum(times) + times, times)
            x = _mixed((sums[places + PASSAGE] - sums[places]) * down[places]).view(np.int64)
            parts.append((x, np.full(len(x), k, np.int64), np.repeat(other, times)))
        if parts:
            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("x", "one", "other"), zip(*parts, strict=True), strict=True)})


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of data in the order of their first `depth` bytes or more, by two-stage sorting.

    A suffix is small if it is less than the one that starts a byte later. The small ones are sorted directly. The others
    follow from a scan over the buckets of first bytes, from left to right: a large suffix stands in its bucket in the
    order of its successor, and before all small ones of that bucket.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.append(np.sign(np.diff(text.astype(np.int16))), -1)
    nonzero = np.flatnonzero(step)
    small = step[nonzero[np.searchsorted(nonzero, np.arange(n))]] > 0
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: data[i : i + depth]), dtype=np.int64)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[text[-1]].append(np.array([n - 1]))
    small_of = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    out = []
    for c in range(256):
        at = 0
        while at < len(large[c]):
            _induce(large[c][at], text, small, large)
            at += 1
        if len(small_of[c]):
            _induce(small_of[c], text, small, large)
        out += [*large[c], small_of[c]]
    return np.concatenate(out)


def _induce(sorted_: np.ndarray, text: np.ndarray, small: np.ndarray, large: list[list[np.ndarray]]) -> None:
    """Appends the large suffixes one byte before the sorted ones to their buckets, in order."""
    before = sorted_[sorted_ > 0] - 1
    before = before[~small[before]]
    if len(before):
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        for run, c in zip(np.split(before, edges[1:]), first[edges].tolist(), strict=True):
            large[c].append(run)


def common_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in the order of suffixes, how many bytes they have in common, up to `depth`."""
    text = np.frombuffer(data + bytes(depth + 8), np.uint8)
    eights = np.lib.stride_tricks.as_strided(text, (len(data) + depth, 8), (1, 1)).copy().view("<u8").ravel()
    one, other = order[:-1], order[1:]
    most = np.minimum(depth, len(data) - np.maximum(one, other))
    out = np.zeros(len(one), np.int64)
    live = np.flatnonzero(most > 0)
    for at in range(0, depth, 8):
        apart = eights[one[live] + at] ^ eights[other[live] + at]
        ends = apart != 0
        low = apart[ends] & (~apart[ends] + np.uint64(1))
        out[live[ends]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~ends]
        if not len(live):
            break
        out[live] = at + 8
    return np.minimum(out, most)


def repeated_starts(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, the starts of its strings of MATCH bytes that also start elsewhere in any of them."""
    data = END.join(strings) + END
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    whole = np.zeros(len(data), bool)
    for first, length in zip(firsts.tolist(), lengths.tolist(), strict=True):
        whole[first : max(first, first + length - MATCH + 1)] = True
    order = suffix_array(data, MATCH)
    order = order[whole[order]]  # suffixes between two with a common prefix of MATCH bytes have it too, so none is left out there
    same = common_prefixes(data, order, MATCH) >= MATCH
    again = np.zeros(len(data), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [np.flatnonzero(again[f : f + k]) for f, k in zip(firsts.tolist(), lengths.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), (starts[np.append(breaks, len(starts) - 1)] + MATCH).tolist(), strict=True))


def may_repeat(strings: list[bytes], anchors: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Whether a context may hold a string of MATCH bytes that another one with its anchor has, and one of the two has no copies.

    Equal strings have their anchor at the same place, with SPAN - 1 bytes around it: half of them or more are before it or
    after it. So contexts in question agree in that many bytes on one side of the anchor. Where its k-gram stands in a
    context several times, each place counts.
    """
    half = (SPAN - 1) // 2
    data = END.join(strings) + END
    lengths = np.array([len(s) for s in strings], np.int64)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    sums, down = _rolling(_BYTES[np.frombuffer(data, np.uint8)])
    n = len(data)
    grams = _mixed((sums[GRAM:] - sums[: n + 1 - GRAM]) * down[: n + 1 - GRAM])
    row = np.repeat(np.arange(len(strings)), lengths + 1)[: len(grams)]
    at = np.flatnonzero((grams == anchors[row]) & (np.arange(len(grams)) + GRAM <= (firsts + lengths)[row]))
    out = np.zeros(len(strings), bool)
    for before, after in ((half, 0), (0, half)):
        lo, hi = at - before, at + GRAM + after
        inside = (lo >= firsts[row[at]]) & (hi <= (firsts + lengths)[row[at]])
        lo, hi, of = lo[inside], hi[inside], row[at[inside]]
        if len(of):
            side = pd.DataFrame({"h": anchors[of], "x": (sums[hi] - sums[lo]) * down[lo], "of": of, "single": copies[of] == 1})
            groups = side.groupby(["h", "x"], sort=False)
            out[of[(groups["of"].transform("min") != groups["of"].transform("max")) & groups["single"].transform("max")]] = True
    return out


def _sort_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of the contexts that occur once, from rows sorted by anchor; blocks hold whole anchors."""
    held: list[tuple] = []
    size = 0

    def flush() -> pd.DataFrame:
        asked = may_repeat([r[6] for r in held], np.array([r[0] for r in held], np.int64).view(np.uint64), np.array([r[5] for r in held], np.int64))
        rows = [r for r, may in zip(held, asked.tolist(), strict=True) if may]
        found = repeated_starts([r[6] for r in rows]) if rows else []
        spans = [(r[1], r[2], r[3] + s, r[3] + e) for r, starts in zip(rows, found, strict=True) if r[5] == 1 for s, e in _runs(starts)]
        return pd.DataFrame(spans, columns=["doc_id", "t", "s", "e"])

    for batch in batches:
        for row in zip(batch["h"], batch["doc_id"], batch["t"], batch["lo"], batch["len"], batch["n"], batch["bytes"], strict=True):
            if held and held[-1][0] != row[0] and size >= BLOCK:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush()


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, t, text, spans in zip(batch["doc_id"], batch["t"], batch["text"], batch["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            ends = [0, *(e for _, e in merged)]
            kept = hashlib.sha256(b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(data)], strict=True)))
            rows.append((doc_id, t, sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"s": s, "e": e} for s, e in merged]))
        yield pd.DataFrame(rows, columns=["doc_id", "t", "n_removed", "n_spans", "kept", "spans"])


def anchored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed(doc_id, t, k, text) documents, and (passage, h, c, doc_id, t, lo, len), their contexts with anchors that occur more than once, with `mixed`.

    t is a hash of the text, so that documents with one id but several texts are told apart; k is a hash of both. Ids are texts
    here. Contexts of words carry k alone, as t.
    """
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    keyed = keyed.withColumn("k", F.xxhash64("doc_id", "t"))
    long = F.octet_length("text") >= 2 * PASSAGE - 1
    anchors = cut(keyed.filter(long).mapInPandas(_anchors, "passage boolean, h long, c long, doc_id string, t long, lo int, len int"))
    common = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("all"), F.min("c").alias("one"), F.max("c").alias("other")).filter(F.col("all") > 1)
    return keyed, cut(anchors.join(cut(common.select("h", (F.col("one") != F.col("other")).alias("mixed"))), "h"))


def shared_windows(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """(k, n_shared_windows): how many windows of PASSAGE words of a document another document has too.

    A context that two documents have is shared as a whole. Of the others, those with an anchor in common are compared window
    by window, one document of each kind of context for all. Rows with the same id and text are one document.
    """
    own = shared.filter("passage").select("h", "c", F.col("t").alias("k"), (F.col("lo").cast("long") * 64 + F.col("len")).alias("at"), "mixed")
    kinds = cut(own.groupBy("h", "c").agg(F.min("k").alias("one"), F.max("k").alias("other"), F.max("mixed").alias("mixed"), F.min_by("at", "k").alias("at")))
    copied = kinds.filter("one <> other").select("h", "c")
    whole = salted_semi(own.select("h", "c", "k", "at"), copied, ["h", "c"], F.struct("k", "at")).select("k", "at").distinct().select("k", F.col("at").bitwiseAND(F.lit(63).cast("long")).alias("n"))
    asked = cut(kinds.filter("mixed").groupBy(F.col("one").alias("_k")).agg(F.collect_list(F.struct("at", "other")).alias("asked")))
    texts = keyed.join(asked, F.col("k") == F.col("_k")).dropDuplicates(["k"]).select("k", "text", "asked")
    windows = cut(texts.mapInPandas(_windows, "x long, one long, other long"))
    again = cut(windows.groupBy("x").agg(F.min("one").alias("least"), F.max("other").alias("most")).filter("least <> most").select("x"))
    single = salted_semi(windows.filter("one = other"), again, ["x"], F.col("one")).select(F.col("one").alias("k"), F.lit(1).cast("long").alias("n"))
    return whole.union(single).groupBy("k").agg(F.sum("n").alias("n_shared_windows"))


def repeated_spans(keyed: DataFrame, contexts_: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, spans) of the documents with repeated strings, and (doc_id, t, text) of those that may have some."""
    shared = contexts_.filter(~F.col("passage")).drop("passage")
    whole = shared.filter(~F.col("mixed")).select("doc_id", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("len")).alias("e"))
    mixed = shared.filter("mixed")
    kinds = cut(mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "lo", "len")).alias("rep")))
    copied = kinds.filter("n > 1").select("h", "c")
    whole = whole.union(salted_semi(mixed, copied, ["h", "c"], F.struct("doc_id", "lo")).select("doc_id", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("len")).alias("e")))
    key = F.struct("doc_id", "t")
    needs = kinds.groupBy(F.struct("rep.doc_id", "rep.t").alias("_key")).agg(F.collect_list(F.struct("h", "n", "rep.lo", "rep.len")).alias("needs"))
    involved = shared.select(key.alias("_key")).distinct().join(needs, "_key", "left")
    texts = cut(keyed.withColumn("_key", key).join(cut(involved), "_key").dropDuplicates(["_key"]).select("doc_id", "t", "text", "needs"))
    crowds = cut(kinds.groupBy("h").count().filter(F.col("count") > crowd).select("h"))
    asked = texts.select("doc_id", "t", F.col("text").cast("binary").alias("b"), F.explode("needs").alias("x"))
    asked = asked.select("x.h", "doc_id", "t", "x.lo", "x.len", "x.n", F.expr("substring(b, x.lo + 1, x.len)").alias("bytes"))
    calm = asked.join(crowds, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    sorted_ = calm.mapInPandas(_sort_suffixes, "doc_id string, t long, s int, e int")
    spans = whole.union(sorted_)
    if crowds.head(1):
        strings = asked.join(crowds, "h", "left_semi").select("doc_id", "t", "lo", "n", "bytes", F.explode(F.sequence(F.lit(0), F.col("len") - MATCH)).alias("at"))
        string = F.expr(f"substring(bytes, at + 1, {MATCH})")
        strings = strings.select("doc_id", "t", (F.col("lo") + F.col("at")).alias("s"), "n", F.xxhash64(string).alias("x"), F.xxhash64(F.lit(1), string).alias("y"))
        again = cut(strings.groupBy("x", "y").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("x", "y"))
        spans = spans.union(salted_semi(strings.filter("n = 1"), again, ["x", "y"], F.struct("doc_id", "s")).select("doc_id", "t", "s", (F.col("s") + MATCH).alias("e")))
    return spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans")), texts.select("doc_id", "t", "text")


def deduplicate(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_shared_windows), one row per input row.

    A byte goes if a string of MATCH bytes that covers it also starts anywhere else, in the same document too. Null and
    empty texts, and those shorter than MATCH bytes, lose nothing. Equal rows are copies of each other and lose all of it. An
    empty table gives no rows. n_shared_windows counts the windows of PASSAGE words, blanks between them aside, that a
    document with another id or text has too; such passages may be shorter than MATCH bytes, and are told, not removed.
    """
    keyed, contexts_ = anchored(docs)
    spans, texts = repeated_spans(keyed, contexts_, crowd)
    joined = texts.withColumn("_key", F.struct("doc_id", "t")).join(cut(spans.select(F.struct("doc_id", "t").alias("_key"), "spans")), "_key").drop("_key")
    removed = joined.mapInPandas(_remove, "doc_id string, t long, n_removed long, n_spans long, kept string, spans array<struct<s:int,e:int>>").select(F.struct("doc_id", "t").alias("_key"), "n_removed", "n_spans", "kept", "spans")
    windows = shared_windows(keyed, contexts_)
    text = F.coalesce("text", F.lit(""))
    id_, t = F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), F.struct(id_, t).alias("_key"), F.xxhash64(id_, t).alias("k"))
    none = F.lit(0).cast("long")
    joined = rows.join(cut(removed), "_key", "left").join(cut(windows), "k", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), "spans", F.coalesce("n_shared_windows", none).alias("n_shared_windows"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: deduplicate(table(spark, sf_dir, "documents")).drop("spans"))[0]
