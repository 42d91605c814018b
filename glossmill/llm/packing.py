"""Conflict-constrained best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import cut, settled, table, words_of

#: Words a bin holds, and pieces a shard holds at most on average.
CAPACITY = 2048
SHARD = 4096
WORD_RUN = r"[^\x20\x09-\x0D]+"


def copy_cluster(text: Column) -> Column:
    """Documents with the same words, letters in either case, are copies of each other."""
    return F.xxhash64(F.lower(F.array_join(words_of(text), " ")))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given.

    Open bins stand in a list ordered by (residual, bin). The search starts at the first residual that is large enough and
    goes on to the next larger one while the bin's bitmaps hold the item's source or cluster; so the first compatible bin is
    the tightest one. sources and clusters are small whole numbers; -1 conflicts with nothing.
    """
    order: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        i = bisect_left(order, (size, -1))
        while i < len(order) and (source_bits[order[i][1]] & s or cluster_bits[order[i][1]] & c):
            i += 1
        if i < len(order):
            residual, b = order.pop(i)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        insort(order, (residual - size, b))
        bins.append(b)
        offsets.append(capacity - residual)
    return bins, offsets


def _pack_shard(capacity: int, columns: list[str]):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sources = pd.factorize(rows["source"])[0]  # -1: null
        shared = rows["cluster"].duplicated(keep=False)
        clusters = pd.factorize(rows["cluster"].where(shared))[0]
        bins, offsets = best_fit(rows["n_words"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        rows["bin_id"] = rows["shard"].map(lambda s: s << 24) + pd.Series(bins, dtype="int64")
        rows["bin_offset"] = pd.Series(offsets, dtype="int64")
        return rows.sort_values(["bin_id", "bin_offset"], kind="stable")[columns]

    return pack


def _piece_texts(words: Column, pieces: Column, capacity: int) -> Column:
    """The text of every piece: its words and the blanks after each; the first piece has those before its first word too. In a row they are the text.

    Words and blanks are bound to x, so that a text is split once for all its pieces.
    """
    split = F.array(F.struct(words.alias("words"), F.split("text", WORD_RUN).alias("gaps")))
    part = lambda array, i, skip: F.slice(array, (i * capacity + 1 + skip).cast("int"), F.lit(capacity))
    joined = lambda x, i: F.array_join(F.zip_with(part(x["words"], i, 0), part(x["gaps"], i, 1), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
    each = F.transform(split, lambda x: F.transform(pieces, lambda i: F.concat(F.when(i == 0, F.get(x["gaps"], F.lit(0))).otherwise(""), joined(x, i))))
    return F.when(F.size(pieces) == 1, F.array(F.coalesce("text", F.lit("")))).otherwise(F.get(each, F.lit(0)))


def _dealt(pieces: DataFrame, shard: int, shards: int) -> DataFrame:
    """Adds the shard: a hash of the piece's values. Pieces that are equal more than `shard` / 4 times are dealt by their place as well.

    The place, _place, is a column of the stored table, so a task that is run again deals as it did before.
    """
    keyed = pieces.withColumn("_deal", F.xxhash64("doc_id", "piece", "source", "cluster"))
    hot = cut(keyed.groupBy("_deal").count().filter(F.col("count") * 4 > shard).select("_deal", F.lit(True).alias("_hot")))
    if hot.head(1):
        keyed = keyed.join(hot, "_deal", "left").withColumn("_deal", F.when(F.col("_hot"), F.xxhash64("_deal", "_place")).otherwise(F.col("_deal"))).drop("_hot")
    return keyed.withColumn("shard", F.pmod("_deal", F.lit(shards))).drop("_deal")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, texts: bool = True) -> DataFrame:
    """(doc_id, piece, first_word, n_words, source, bin_id, bin_offset, text): every word of every row is in one bin.

    A bin's training sequence is its pieces' text in the order of bin_offset; rows of a bin stand together in that order. text
    is left out where `texts` is false. A text longer than a bin is cut into pieces, which in a row are the text again; full
    pieces fill a bin alone. No bin holds two pieces of one source or of one cluster of copies; a null source conflicts with
    nothing, and neither does a text without words by its cluster. Null and empty texts are a piece of 0 words. Pieces are
    dealt into shards by a hash, so a hot source or a large group of copies spreads evenly over all of them, and each shard
    is packed by itself, largest pieces first. Equal rows are packed one by one. An empty table gives no rows.
    """
    words = words_of(F.col("text"))
    sized = docs.select("doc_id", "source", F.size(words).cast("long").alias("words"), F.when(F.size(words) > 0, copy_cluster(F.col("text"))).alias("cluster"), "text")
    last = F.greatest(F.expr(f"(words + {capacity - 1}) div {capacity}"), F.lit(1).cast("long"))
    numbers = F.sequence(F.lit(0).cast("long"), last - 1)
    if texts:
        pieces = sized.select("doc_id", "source", "words", "cluster", F.posexplode(_piece_texts(words, numbers, capacity)).alias("piece", "text"))
    else:
        pieces = sized.select("doc_id", "source", "words", "cluster", F.explode(numbers).alias("piece"))
    pieces = pieces.withColumn("piece", F.col("piece").cast("long")).withColumn("first_word", F.col("piece") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("first_word"), F.lit(capacity).cast("long"))).drop("words")
    pieces = cut(pieces.withColumn("_place", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "first_word", "n_words", "source", "bin_id", "bin_offset"] + (["text"] if texts else [])
    shards = max(1, -(-pieces.count() // shard))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = pieces.withColumns({"doc_id": F.col("doc_id").cast("string"), "cluster": F.col("cluster").cast("string")})  # pandas would read numbers with nulls as floats
    schema = "doc_id string, piece long, first_word long, n_words long, source string, bin_id long, bin_offset long" + (", text string" if texts else "")
    return _dealt(pieces, shard, shards).groupBy("shard").applyInPandas(_pack_shard(capacity, columns), schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: pack(table(spark, sf_dir, "documents"), texts=False))[0]
