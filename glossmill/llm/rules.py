"""Quality rules, and importance by hashed n-grams: is a document more like trusted text or like the raw corpus?"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import BLANKS, crc_mod, table, words_of

BUCKETS = 1 << 15
#: Labelled good documents that the trusted model is counted from, at most. The raw model is counted from every document.
TRUSTED = 4000
#: Documents below this mean log-likelihood ratio an n-gram are dropped.
THRESHOLD = -0.12
SMOOTHING = 1.0
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds words, their hashes, and the buckets of all words and word pairs."""
    mask = F.lit(BUCKETS - 1).cast("long")
    bucket = lambda h: h.bitwiseAND(mask).cast("int")
    docs = docs.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = F.transform(F.slice("hashes", F.lit(2), F.size("hashes")), lambda h, i: bucket(F.xxhash64(F.get("hashes", i), h)))
    return docs.withColumn("grams", F.concat(F.transform("hashes", bucket), pairs))


def _base(docs: DataFrame) -> DataFrame:
    """Adds n_words and the base counts to documents with words and hashes."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    counted = docs.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "lines": lines,
        "windows": F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)])),
    })
    counted = counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    counted = counted.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    twin = lambda e, k: F.coalesce(e["h"] == F.get("sorted", k)["h"], F.lit(False))
    counted = counted.withColumn("starts", F.sort_array(F.transform(F.filter("sorted", lambda e, k: twin(e, k - 1) | twin(e, k + 1)), lambda e: e["at"])))
    covered = F.transform("starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - at, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long")
    return counted.withColumn("n_repeat_words", repeated).drop("lines", "windows", "sorted", "starts")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted / raw) of each bucket, from all documents and those whose ids are in trusted(_id), a bounded table.

    Without trusted documents all ratios are 0.
    """
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
    # explode_outer: for explode, the optimiser adds a filter on the arrays and pushes it below the columns they are built of.
    grams = _hashed(flagged).select(F.col("_id").isNotNull().cast("long").alias("t"), F.explode_outer("grams").alias("b"))
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for b, n, t in grams.groupBy("b").agg(F.count(F.lit(1)), F.sum("t")).filter("b is not null").collect():
        raw[b] += n
        good[b] += t
    if sum(good) == SMOOTHING * BUCKETS:
        return [0.0] * BUCKETS
    shift = log(sum(raw) / sum(good))
    return [round(log(g / r) + shift, 6) for g, r in zip(good, raw, strict=True)]


def trusted_ids(labels: DataFrame, rows: int = TRUSTED) -> DataFrame:
    """(_id): up to `rows` documents labelled good, in the order of a hash of their ids, none with crc32 modulo 3 of 1."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").alias("_id")).distinct()
    return good.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def apply_rules(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs' ids with base counts, base_failed, kept and score, one row per input row.

    score is the mean log-ratio of the document's words and word pairs; every document is held against the same threshold.
    Null and empty texts have no words, score 0 and fail the base rules. Equal rows get equal verdicts; an empty table gives
    no rows.
    """
    weights = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    scored = _base(_hashed(docs.select("doc_id", "text"))).withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, log_ratios(docs, trusted_ids(table(spark, sf_dir, "labels"))))
