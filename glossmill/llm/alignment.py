"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

Both tokenizers cut a text's bytes. Offsets where tokens of both end cut it into groups, and every token of a group is linked
with every token of the other side in that group. A batch of texts is aligned at once: the ends of all tokens are a cumulative
sum of their lengths, the common cuts are where the two lists of ends intersect (the end of a text is always one), a binary
search in the cuts gives each token its group, and repeats of the first side's tokens by the size of the other side expand
the links, BLOCK at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import cut, settled, stored, table

#: The folder of the vocabulary files, and the two tokenizers. The driver reads them and sends them to the tasks: their size is
#: that of the files, whatever the input.
FOLDER = "/opt/tokenizers"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that are aligned together, and links that are expanded together.
BATCH, BLOCK = 1 << 20, 1 << 22
#: Pairs that are held back to be counted in one task, and places over which the counts of a pair are spread first.
HELD, SALTS = 1 << 22, 16
#: The most frequent pairs, whose counts every task gets; those of all others are joined. The number changes no result.
HOT = 1 << 18

# Fixed value: the pattern that splits a text before merges, as byte-level vocabularies use it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The printable characters that byte-level vocabularies write as themselves; the other bytes are, in order,
# the characters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of_character() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list], tokens: list[bytes], whole: bool = False):
        self.encode, self.tokens = encode, tokens
        self.whole = whole  # tokens always join to the text's bytes, so that need not be looked at
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.joins = [[f"{k}{sign}" for k in range(len(tokens))] for sign in (",", "|", ";")]


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes and id of each token, if merges are ranked as their ids are; then a library that takes ranks gives the same ids."""
    to_byte = byte_of_character()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in merged]
    if ids != list(range(len(to_byte), len(to_byte) + len(ids))) or len(model["vocab"]) != len(to_byte) + len(ids):
        return None
    return {bytes(map(to_byte.__getitem__, t)): k for t, k in model["vocab"].items()}


@lru_cache(2)
def byte_level(content: bytes) -> Side:
    """A byte-level BPE from its file; strings of special tokens are ordinary text. Texts get a space before them.

    Where the file's merges are ranked by id and its texts are split by the usual pattern alone, tiktoken encodes by them, which
    takes a fifth of the time; any other file is left to its own library.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    described, to_byte = json.loads(content), byte_of_character()
    ranks = _ranks(described["model"]) if described["model"].get("type") == "BPE" else None
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if ranks and not described.get("normalizer") and usual.items() <= (described.get("pre_tokenizer") or {}).items():
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        return Side(lambda texts: [own.encode_ordinary(" " + t) for t in texts], tokens, True)
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(content.decode())
    own.encode_special_tokens = True
    names = [own.id_to_token(k) or "" for k in range(own.get_vocab_size())]
    tokens = [bytes(map(to_byte.__getitem__, t)) if all(c in to_byte for c in t) else t.encode() for t in names]
    return Side(lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], tokens)


@lru_cache(2)
def pieces(content: bytes) -> Side:
    """A sentence-piece model from its file; it puts a space before a text by itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=content)
    n = own.get_piece_size()
    tokens = [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode() for k in range(n)]
    return Side(lambda texts: own.encode(texts, num_threads=1), tokens)


def _both(a: Side, b: Side, texts: list[str | None]) -> tuple[list, list]:
    """ids of each text on both sides; none where a text is null or empty, or tokens of a side do not join to its bytes."""
    asked = [t or "" for t in texts]
    ours, theirs = a.encode(asked), b.encode(asked)
    for k, text in enumerate(asked):
        raw = b" " + text.encode("utf-8", "surrogatepass")
        if not text or any(not side.whole and b"".join(map(side.tokens.__getitem__, ids[k])) != raw for side, ids in ((a, ours), (b, theirs))):
            ours[k], theirs[k] = [], []
    return ours, theirs


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(keys) else times


def _expanded(group_a: np.ndarray, id_a: np.ndarray, group_b: np.ndarray, id_b: np.ndarray, doc_of: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, times): each text's distinct pairs, key = (text * na + a) * nb + b, and how many links each one stands for.

    Equal tokens of a group count once with their number, so that a long stretch without a common cut expands to no more than
    its distinct tokens. Each token of A is repeated for every one of B in its group.
    """
    key_a, n_a = _counted(group_a * na + id_a, np.ones(len(id_a), np.int64))
    key_b, n_b = _counted(group_b * nb + id_b, np.ones(len(id_b), np.int64))
    ga, gb = key_a // na, key_b // nb
    groups = len(doc_of)
    size_b = np.bincount(gb, minlength=groups)
    start_b = np.cumsum(size_b) - size_b
    upto = np.cumsum(size_b[ga])
    found, at = [], 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        g, reps = ga[at:to], size_b[ga[at:to]]
        left = np.repeat(np.arange(at, to), reps)
        right = np.repeat(start_b[g], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        pair = (doc_of[ga[left]] * na + key_a[left] % na) * nb + key_b[right] % nb
        found.append(_counted(pair, n_a[left] * n_b[right]))
        at = to
    return _counted(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(a: Side, b: Side, texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of each text; keys are a * (size of B) + b, ascending."""
    ours, theirs = _both(a, b, texts)
    na, nb = len(a.tokens), len(b.tokens)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (ours, theirs))
    id_a, id_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ours, n_a), (theirs, n_b)))
    ends_a, ends_b = np.cumsum(a.sizes[id_a]), np.cumsum(b.sizes[id_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty, so ends rise
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_a = np.cumsum(n_a)
    groups_upto = np.where(last_a > 0, group_a[last_a - 1] + 1, 0) if len(id_a) else np.zeros(len(texts), np.int64)
    n_groups = np.diff(groups_upto, prepend=0)
    doc_of = np.repeat(np.arange(len(texts)), n_groups)
    of_a, of_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc_of, of_a * of_b)
    keys, times = _expanded(group_a, id_a, group_b, id_b, doc_of, na, nb)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * (na * nb))
    # the groups as text: a token is followed by a comma, the last of A in a group by a bar, the last of B by a semicolon
    sign_a = np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.zeros(0, bool)
    sign_b = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, bool)
    place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    names = np.concatenate([np.where(sign_a, na, 0) + id_a, 2 * na + np.where(sign_b, nb, 0) + id_b])[place].tolist()
    said = [*a.joins[0], *a.joins[1], *b.joins[0], *b.joins[2]]
    out, at = [], 0
    for k in range(len(texts)):
        n = int(n_a[k] + n_b[k])
        whole = "".join(map(said.__getitem__, names[at : at + n]))[:-1]
        at += n
        at_keys = slice(bounds[k], bounds[k + 1])
        out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(whole.encode()).hexdigest() if n else "", keys[at_keys] - k * na * nb, times[at_keys]))
    return out


def groups_of(a: Side, b: Side, text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as ids of both sides, for looking at."""
    (ours,), (theirs,) = _both(a, b, [text])
    ends_a, ends_b = np.cumsum(a.sizes[ours].astype(np.int64)), np.cumsum(b.sizes[theirs].astype(np.int64))
    cuts = np.intersect1d(ends_a, ends_b)
    ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    return [([i for i, g in zip(ours, ga, strict=True) if g == k], [i for i, g in zip(theirs, gb, strict=True) if g == k]) for k in range(len(cuts))]


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def _aligned(contents) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(contents.value[0]), pieces(contents.value[1])
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= BATCH):
                    size += len(texts[to] or "")
                    to += 1
                found = list(zip(*align(a, b, texts[at:to]), strict=True))
                columns = [pa.array(c, pa.int64()) for c in found[:4]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns, pa.array(found[4], pa.string()), _lists(found[5], pa.int64()), _lists(found[6], pa.int64())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])
                at = to

    return aligned


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a stretch have each pair."""

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size > HELD:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """(key, n): how many rows of aligned(keys) hold each pair; counted in the tasks, then over `salts` places, then as a whole."""
    some = aligned.select("keys").mapInArrow(_pair_counts, "key long, n long").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return some.groupBy("key", "_salt").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, of_b: int) -> DataFrame:
    """counts(key, n) with best: whether no other pair of the same A id has more. There is a row for each id of A to compare with."""
    a = F.expr(f"key div {of_b}")
    most = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_a", a).join(F.broadcast(most), "_a").select("key", "n", (F.col("n") == F.col("_most")).alias("best"))


def _hot_sums(keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("keys"))
            sizes = np.diff(listed.offsets.to_numpy())
            own = listed.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hot = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, row[hot], times[hot] * n[at[hot]])
            np.add.at(good, row[hot], times[hot] * best[at[hot]])
            rest = np.bincount(row[~hot], minlength=len(sizes))
            offsets = pa.array(np.cumsum([0, *rest]), pa.int32())
            cold = [pa.ListArray.from_arrays(offsets, pa.array(x[~hot], pa.int64())) for x in (own, times)]
            kept = [batch.column(k) for k, name in enumerate(batch.schema.names) if name not in ("keys", "times")]
            names = [name for name in batch.schema.names if name not in ("keys", "times")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(good), pa.array(total), *cold], [*names, "n_best", "count_sum", "keys", "times"])

    return sums


def aligned(docs: DataFrame, folder: str = FOLDER, a: str = A, b: str = B) -> tuple[DataFrame, int]:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times, _row), one row per input row, stored; and the size of B.

    keys are the row's distinct linked pairs, times the links that each one stands for. A text has no tokens if it is null or
    empty, or if the tokens of either side do not join to its bytes with a space before them. _row tells rows apart; it is
    part of the stored table, so it stays the same whatever is computed again.
    """
    contents = []
    for name in (a, b):
        with open(os.path.join(folder, name), "rb") as file:
            contents.append(file.read())
    sent = docs.sparkSession.sparkContext.broadcast(contents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_aligned(sent), f"doc_id {kind}, {_COUNTS}, keys array<long>, times array<long>")
    return cut(rows.withColumn("_row", F.monotonically_increasing_id())), len(pieces(contents[1]).tokens)


def links(docs: DataFrame, folder: str = FOLDER, a: str = A, b: str = B) -> DataFrame:
    """(a, b, n, best): the corpus's linked pairs of ids, how many rows hold each, and whether it is its A id's most frequent one."""
    rows, of_b = aligned(docs, folder, a, b)
    counts = with_best(cut(pair_counts(rows)), of_b)
    return counts.select(F.expr(f"key div {of_b}").alias("a"), (F.col("key") % of_b).alias("b"), "n", "best")


def summaries(docs: DataFrame, folder: str = FOLDER, a: str = A, b: str = B, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    n_best counts the links whose pair is the most frequent one of its A id in all of docs, ties included; count_sum adds up
    the counts of all links' pairs. Equal rows each have their row and count; rows without tokens have zeros; an empty table
    gives no rows. The `hot` most frequent pairs come to the driver and go to every task with their counts; all other pairs of
    a row meet theirs in a join.
    """
    rows, of_b = aligned(docs, folder, a, b)
    counts = cut(with_best(cut(pair_counts(rows)), of_b))
    most = counts.orderBy(F.desc("n"), "key").limit(hot).toPandas().sort_values("key")
    known = _hot_sums(most["key"].to_numpy(np.int64), most["n"].to_numpy(np.int64), most["best"].to_numpy(np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()
    partly, _ = stored(rows.mapInArrow(known, f"doc_id {kind}, {_COUNTS}, _row long, n_best long, count_sum long, keys array<long>, times array<long>"))
    cold = partly.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("_row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    joined = cold.join(counts, "key").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    found = partly.drop("keys", "times").join(joined, "_row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: summaries(table(spark, sf_dir, "documents")))[0]
