"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import cut, packed, prefix_sums, row_hash, settled, table, word_count

#: Expected copies are whole multiples of 1/UNIT, so prefix sums are exact and do not depend on the partitioning.
UNIT = 1 << 24
WEIGHTS = (5, 2, 1)
SEED = 17


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): weights are dealt to sources by code point, null last, and repeat.

    The sources share `share` times all sizes by weight. A target stops at `cap` times its source's size, and what is above
    goes to the others by weight, until none is above. Each round saturates at least one source and reads one row.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    ranked = prefix_sums(sources.withColumn("_one", F.lit(1)).withColumn("_null", F.col("source").isNull().cast("int")), [], ["_null", "source"], "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")))
    total, caps = ranked.agg(F.sum("source_size"), F.sum("_cap")).first()
    budget, level, capped = share * (total or 0), 0.0, -1
    full = F.lit(False)
    while True:
        held, free, n = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)), F.coalesce(F.sum(full.cast("int")), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - held) / free
        full = F.col("_cap") <= F.col("_w") * level
    return ranked.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = SEED, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, keep..), one row per input row.

    Within a source the documents stand in the order of size, then id, then what is to be kept. Each expects target / source_size copies; the
    expected copies are summed along the order, one random offset of the source is added, and a document is taken once for
    each whole number that its interval crosses. Neighbours in that order are of like size, so what is taken stays near the
    target. A text that is null has size 0; such rows get copies like any other, and weigh nothing. A null source is a
    source; equal rows are told apart only by their place; an empty table gives no rows.
    """
    keep = keep or {}
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[c.alias(name) for name, c in keep.items()]))
    targets = source_targets(sized, weights, share, cap)
    step = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    steps = targets.select(F.col("source").alias("_s"), "source_size", "target", step.alias("_step"))
    joined = sized.join(steps, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    summed = prefix_sums(joined, ["source"], ["size", "doc_id", *keep], "_step", "_end")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    copies = F.expr(f"(_end + _offset) div {UNIT} - (_end - _step + _offset) div {UNIT}")
    return summed.withColumn("_offset", offset).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_end", "_step", "_offset")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: mix(table(spark, sf_dir, "documents")))[0].select("doc_id", "size", "source_size", "target", "taken")


def take_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mix() takes it, with the columns that came in.

    Rows are told apart by two hashes of all their columns. Rows that are equal in all of them are interchangeable, and one
    of them stands for all their copies. An empty table gives no rows.
    """
    key = F.struct(row_hash(docs).alias("x"), row_hash(docs, 1).alias("y"))
    taken = mix(docs, keep={"_key": key}).groupBy("_key").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    first = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    rows = packed(docs, key.alias("_key")).withColumn("_nth", first).filter("_nth = 1").join(cut(taken), "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as k from sized group by source
), weighed as (
  select *, case (k - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w, (2 * source_size)::double as cap from sources
), filled as (
  select *, sum(cap) over o as caps, sum(w) over o as ws, 1.5::double * sum(source_size) over () as budget, sum(w) over () as all_w
  from weighed window o as (order by cap / w, k rows unbounded preceding)
), levels as (
  select (budget - (caps - cap)) / (all_w - (ws - w)) as level, cap / w as own, k from filled
), level as (
  select arg_min(level, struct_pack(own := own, k := k)) filter (where level < own) as level from levels
), targets as (
  select source, source_size, least(cap, coalesce(w * level, cap)) as target from weighed, level
), steps as (
  select s.doc_id, s.size, t.source_size, t.target, t.source,
    case when t.source_size > 0 then round(t.target / t.source_size * {UNIT})::bigint else 0 end as step
  from sized s join targets t on s.source is not distinct from t.source
), summed as (
  select *, sum(step) over (partition by source order by size, doc_id rows unbounded preceding)::bigint as upto,
    ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 6))::bigint as shift
  from steps
)
select doc_id, size, source_size, target, ((upto + shift) // {UNIT} - (upto - step + shift) // {UNIT}) * size as taken from summed
"""
