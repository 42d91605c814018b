"""Ranked lexical search: an inverted index in shards, and document-at-a-time search of each shard.

A shard holds the documents of one stretch of the input, sorted by id. Its posting lists are ascending places in that order, as
gaps, with the term's occurrences, both in as few bytes as they need. A query's lists are merged by a heap that always gives
the list with the least next document, so a document is scored once, with all its terms; a bounded heap keeps the best
documents, keyed by score and then by id. Lists whose terms together cannot lift a document into that heap are not merged but
only looked into for documents of the other lists, which changes no result. The best of all shards are merged at the end.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import cut, settled, table

#: What is no term: ASCII but for letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents returned for a query.
BEST = 20
#: Terms of a shard's documents, about: a longer document is a shard of its own.
SHARD = 1 << 20
#: Queries that are answered in one walk through a shard.
QUERIES = 256

_TERM = re.compile(TERM)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")) if text else []


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): numbers from 0 on as groups of seven bits, the lowest first, and where each one ends.

    All but a number's last byte have the highest bit set.
    """
    values = values.astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    out = (np.repeat(values, n) >> (7 * nth).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    out[nth < np.repeat(n, n) - 1] |= 128
    return out, ends


def packed_numbers(values: np.ndarray) -> bytes:
    return _packed(values)[0].tobytes()


def _packed_lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The numbers from each start to the next one as bytes, all packed at once."""
    raw, ends = _packed(values)
    offsets = np.append(0, ends)[starts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def unpacked_numbers(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    starts = np.flatnonzero(np.append(True, last[:-1]))
    nth = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, starts)


class _Shard:
    """Documents that are gathered until there are enough for a shard."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.terms: list[list[str]] = []
        self.n = 0

    def add(self, doc_id, terms: list[str]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.terms.append(terms)
        self.n += len(terms)

    def rows(self, kind: pa.DataType, shard: int) -> Iterator[pa.RecordBatch]:
        """One row of the documents, without a term, and one for each term."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0, self.sizes[k]))
        known: dict[str, int] = {}
        number = known.setdefault
        ids = np.fromiter((number(t, len(known)) for t in chain.from_iterable(self.terms[k] for k in order)), np.int64, self.n)
        sizes = np.array([self.sizes[k] for k in order], np.int64)
        key, tf = np.unique(ids * len(order) + np.repeat(np.arange(len(order)), sizes), return_counts=True)
        term, place = np.divmod(key, len(order))
        starts = np.searchsorted(term, np.arange(len(known) + 1))
        gaps = np.diff(place, prepend=0)
        gaps[starts[:-1]] = place[starts[:-1]]
        n, names = len(known), ["shard", "term", "df", "total", "places", "times", "ids"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(kind)]
        head = [[shard], [None], [len(order)], [self.n], [packed_numbers(sizes)], [None], [[self.ids[k] for k in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(head, kinds, strict=True)], names)
        columns = [pa.array(np.full(n, shard)), pa.array(known, pa.string()), pa.array(np.diff(starts)), pa.array(np.add.reduceat(tf, starts[:-1]))]
        yield pa.RecordBatch.from_arrays([*columns, _packed_lists(gaps, starts), _packed_lists(tf, starts), pa.nulls(n, kinds[-1])], names)


def _shards(of_task: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, nth, kind, open_ = TaskContext.get().partitionId() << 32, 0, None, _Shard()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if terms:
                    if open_.ids and open_.n + len(terms) > of_task:
                        yield from open_.rows(kind, first + nth)
                        nth, open_ = nth + 1, _Shard()
                    open_.add(doc_id, terms)
        if open_.ids:
            yield from open_.rows(kind, first + nth)

    return shards


def build(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of docs(doc_id, text): (shard, term, df, total, places, times, ids).

    A shard's row without a term has its documents: their ids in order, their lengths as places, their number as df and all
    their terms as total. Each other row is a term's posting list in the shard. Documents without a term are in no shard;
    null ids come last in a shard; equal rows are documents of their own. The text is read once and does not move: shards
    are stretches of the input as it is read. Store the index before searching it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_shards(shard), f"shard long, term string, df long, total long, places binary, times binary, ids array<{kind}>")


def query_terms(items: DataFrame, queries: int = QUERIES) -> tuple[DataFrame, DataFrame, int]:
    """(block, term, items: array of (nth, times)), (nth, item_id), and the number of blocks, of about `queries` items each.

    Equal items are answered one by one; null texts ask nothing.
    """
    numbered = cut(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("nth", F.monotonically_increasing_id()))
    blocks = -(-numbered.count() // queries) or 1
    folded = F.translate(F.coalesce("text", F.lit("")), *_LETTERS)
    each = numbered.select("nth", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).groupBy("nth", "term").count()
    asked = each.groupBy(F.pmod(F.xxhash64("nth"), F.lit(blocks)).alias("block"), "term").agg(F.collect_list(F.struct("nth", F.col("count").alias("times"))).alias("items"))
    return cut(asked), numbered.select("nth", "item_id"), blocks


def weight(n: int) -> Column:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of the column df, with N = n."""
    return F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")


class _Best:
    """The best documents of a query so far: a heap of (score, whether there is an id, the id turned round), the worst one first."""

    def __init__(self, size: int):
        self.size, self.heap, self.least = size, [], 0

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, 0, 0) if doc_id is None else (score, 1, -doc_id)
        if len(self.heap) < self.size:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.size:
            self.least = self.heap[0][0]

    def found(self) -> list[tuple[int, int | None]]:
        return [(score, -turned if there else None) for score, there, turned in self.heap]


def search_shard(lists: list[tuple[list[int], list[int], int]], ids: list, best: _Best) -> None:
    """Offers the shard's documents to best. A list has ascending places, the score of each, and the highest of these."""
    lists = sorted(lists, key=lambda x: x[2])
    upto, bound = [], 0  # what lists up to the k-th can give together
    for x in lists:
        bound += x[2]
        upto.append(bound)
    at = [0] * len(lists)
    # a document that can only equal the worst of a full heap may still have the smaller id, as ids of other shards stand there
    first = next((k for k, u in enumerate(upto) if u >= best.least), len(lists))
    merge = [(lists[k][0][0], k) for k in range(first, len(lists))]
    heapq.heapify(merge)
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            k = merge[0][1]
            places, scores, _ = lists[k]
            p = at[k]
            score += scores[p]
            at[k] = p = p + 1
            if p < len(places) and k >= first:
                heapq.heapreplace(merge, (places[p], k))
            else:
                heapq.heappop(merge)
        for k in range(first - 1, -1, -1):
            if score + upto[k] < best.least:
                break
            places, scores, _ = lists[k]
            p = bisect_left(places, doc, at[k])
            at[k] = p
            if p < len(places) and places[p] == doc:
                score += scores[p]
        if score and score >= best.least:
            before = best.least
            best.offer(score, ids[doc])
            if best.least > before:
                while first < len(lists) and upto[first] < best.least:
                    first += 1


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a unit of weight gives: the occurrences tf of a term in documents of these lengths, of n documents and total terms."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (100 - 25 + 25 * length * n // total))


def _searched(n: int, total: int, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers each block's queries over the shards of a task; rows come by block and shard, a shard's documents first."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shard = ids = lengths = None
        kind = pa.int64()
        found: dict[int, _Best] = {}
        asked: dict[int, list] = {}

        def walk() -> None:
            for nth, lists in asked.items():
                search_shard(lists, ids, found.setdefault(nth, _Best(best)))
            asked.clear()

        def told() -> pa.RecordBatch:
            rows = [(nth, score, doc_id) for nth, b in found.items() for score, doc_id in b.found()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], ["nth", "doc_id", "score"])

        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for b, s, term, places, times, w, items, own in zip(*(batch.column(name).to_pylist() for name in ("block", "shard", "term", "places", "times", "w", "items", "ids")), strict=True):
                if (b, s) != (block, shard):
                    walk()
                    if b != block and found:
                        yield told()
                    block, shard = b, s
                if term is None:
                    ids, lengths = own, unpacked_numbers(places)
                    continue
                at = np.cumsum(unpacked_numbers(places))
                unit = w * impact(unpacked_numbers(times), lengths[at], n, total)
                listed, most, scores = at.tolist(), int(unit.max()), {}
                for item in items:
                    k = item["times"]
                    if k not in scores:
                        scores[k] = (unit * k).tolist()
                    asked.setdefault(item["nth"], []).append((listed, scores[k], most * k))
        walk()
        if found:
            yield told()

    return searched


def search(index: DataFrame, items: DataFrame, best: int = BEST, queries: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its `best` documents with a score above 0, or all.

    index is a stored build(). Ranks are unique, the highest score first, equal ones by ascending id, null ids last. Postings
    of asked terms meet the blocks of queries by term; then a block's share of a shard is in one task, which walks through
    its shards and keeps the best documents of each query over all of them. A more frequent term is in more shards, so its
    rows are more and none is larger than a shard. Empty tables give no rows.
    """
    n, total = (x or 0 for x in index.filter("term is null").agg(F.sum("df"), F.sum("total")).first())
    asked, numbered, blocks = query_terms(items, queries)
    asked = asked.withColumnRenamed("term", "_term")
    frequencies = index.select("term", "df").join(asked.select("_term").distinct(), F.col("term") == F.col("_term"), "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = cut(asked.join(frequencies.select("term", weight(n).alias("w")), F.col("_term") == F.col("term")).filter("w > 0").select("_term", "block", "w", "items"))
    hit = index.select("shard", "term", "places", "times").join(weighted, F.col("term") == F.col("_term")).select("block", "shard", "term", "places", "times", "w", "items")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    heads = index.filter("term is null").select(each_block.alias("block"), "shard", "term", "places", "ids")
    dealt = hit.unionByName(heads, allowMissingColumns=True).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    kind = index.schema["ids"].dataType.elementType.simpleString()
    some = dealt.mapInArrow(_searched(n, total, best), f"nth long, doc_id {kind}, score long")
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(numbered, "nth").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: search(cut(build(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark")))[0]


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""with docs as (select row_number() over () as r, doc_id, {_TERMS_SQL} as terms from documents),
  items as (select row_number() over () as i, item_id, {_TERMS_SQL} as terms from benchmark),
  lengths as (select r, doc_id, len(terms) as n from docs where len(terms) > 0),
  whole as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
  asked as (select i, term, count(*) as times from (select i, unnest(terms) as term from items) group by all),
  postings as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) where term in (select term from asked) group by all),
  weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, whole group by term, n_docs),
  scored as (select i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::bigint as score
    from asked join postings using (term) join weights using (term) join lengths using (r), whole group by i, r),
  ranked as (select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score
    from scored join lengths using (r) join items using (i) where score > 0)
  select item_id, rank, doc_id, score from ranked where rank <= 20"""
