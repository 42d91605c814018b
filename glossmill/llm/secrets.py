"""Secret scans over every version of every text, through a ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import cut, exists, new_path, packed, settled, table


@dataclass(frozen=True)
class Rule:
    """A pattern, matched leftmost and without overlaps; a match counts if `group` of it has `least` characters or more.

    A new version makes every blob unseen for this rule alone.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base rules. For access and hex the least length is part of the pattern: their runs end at the same
#: characters either way, and a text full of short runs is then not cut into them.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
#: Entries of a page of the ledger, the least that is skipped or read.
PAGE = 1000
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    """The content address of a text: SHA-256 of its UTF-8 bytes; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule) -> Column:
    """Length of the gap before each match, of the match and of the tested group, in order."""
    hits, tested = F.regexp_extract_all("text", F.lit(rule.pattern), 0), F.regexp_extract_all("text", F.lit(rule.pattern), rule.group)
    lengths = lambda words: F.transform(words, lambda w: F.length(w))
    found = F.arrays_zip(F.slice(lengths(F.split("text", rule.pattern)), F.lit(1), F.size(hits)).alias("gap"), lengths(hits).alias("hit"), lengths(tested).alias("tested"))
    todo = F.array_contains("todo", rule.name) & F.col("text").rlike(rule.pattern)
    return F.transform(F.when(todo, found), lambda m, k: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.least).alias("least"), k.alias("k"), m["gap"].alias("gap"), m["hit"].alias("hit"), m["tested"].alias("tested")))


def of_batch(ledger: DataFrame, paths: DataFrame) -> DataFrame:
    """The entries of the blobs in paths(blob), stored. Of a ledger in the order of blobs, pages outside of their range are not read."""
    low, high = paths.agg(F.min("blob"), F.max("blob")).first()
    return ledger.filter(F.col("blob").between(low or "", high or "")).join(paths.select("blob").distinct(), "blob", "left_semi")


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, id, todo): each blob that some rule has not seen, a version to read it from, and those rules' names."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("id"))
    if ledger is None:
        return blobs.withColumn("todo", names)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "id", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_blobs(docs: DataFrame, todo: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, start, end): the matches of the unseen pairs, by code points, end exclusive."""
    key = F.struct(F.col("doc_id").alias("id"), blob_of(F.col("text")).alias("blob"))
    texts = docs.select(key.alias("_key"), "text").join(todo.select(F.struct("id", "blob").alias("_key"), "todo"), "_key")
    found = F.flatten(F.filter(F.array(*[_matches(r) for r in rules]), lambda m: m.isNotNull()))
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col("text").rlike(r.pattern)
    rows = texts.filter(any_rule).select(F.col("_key.blob").alias("blob"), F.explode(found).alias("m")).select("blob", "m.*").dropDuplicates(["blob", "rule", "k"])
    upto = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("end", upto).withColumn("start", F.col("end") - F.col("hit")).filter("tested >= least").select("blob", "rule", "start", "end")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, entries) of docs(doc_id, text), all versions of all paths.

    paths(doc_id, blob) has a row per input row. findings(blob, kind, start, end) are those of the blobs in paths, new and
    known. entries(blob, rule, spans) are the new ledger rows: append them, and the next scan reads no blob again until a rule
    gets a new version. Equal rows and equal texts are one blob, scanned once; a null id stands for itself; null and
    empty texts have no findings; an empty table gives empty tables.
    """
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    paths = cut(docs.select("doc_id", blob_of(F.col("text")).alias("blob")))
    ledger = None if ledger is None else of_batch(ledger, paths)
    todo = cut(unseen(paths, ledger, rules))
    new = cut(scan_blobs(docs, todo, rules))
    spans = new.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = todo.select("blob", F.explode("todo").alias("rule"))
    entries = pairs.join(spans, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    findings = new.select("blob", kinds[F.col("rule")].alias("kind"), "start", "end")
    if ledger is not None:
        known = ledger.filter(F.col("rule").isin([r.name for r in rules]))
        findings = findings.union(known.select("blob", kinds[F.col("rule")].alias("kind"), F.explode("spans").alias("s")).select("blob", "kind", "s.start", "s.end"))
    return paths, findings, entries


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The entries stored at a path; none where nothing is stored yet. What is appended later is not seen."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def extend(docs: DataFrame, path: str, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): brings the ledger at `path` up to docs, and gives docs' blobs and the ledger's entries for them and the rules.

    Only blobs and rule versions that the ledger does not hold are scanned, and only their entries are appended. Two runs at
    once may append the same entries twice; they are equal, and read as one.
    """
    spark = docs.sparkSession
    paths, _, entries = scan(docs, read_ledger(spark, path), rules)
    _stored(entries.sortWithinPartitions("blob", "rule"), path)
    return paths, of_batch(read_ledger(spark, path).filter(F.col("rule").isin([r.name for r in rules])), paths)


def _stored(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").option("parquet.page.row.count.limit", PAGE).parquet(path)


def compact(spark: SparkSession, path: str, into: str) -> DataFrame:
    """The ledger at `path` written to the new path `into`, each pair of blob and rule version once, in the order of blobs."""
    once = read_ledger(spark, path).dropDuplicates(["blob", "rule"])
    _stored(once.repartitionByRange("blob").sortWithinPartitions("blob", "rule"), into)
    return read_ledger(spark, into)


def findings_of(entries: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, start, end): a row for each finding of the ledger's entries."""
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    some = entries.filter(F.size("spans") > 0).dropDuplicates(["blob", "rule"])
    return some.select("blob", kinds[F.col("rule")].alias("kind"), F.explode("spans").alias("s")).select("blob", "kind", "s.start", "s.end")


def digests(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """One row per input row: how often each base kind occurs, and the spans, joined back from the ledger's blobs to all their paths.

    `ledger` is the path of a stored ledger, which is extended; without one, a new ledger is made in the shared folder.
    """
    paths, entries = extend(docs, ledger or new_path(docs.sparkSession), rules)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    each = F.struct(F.col("start").alias("at"), order[F.col("kind")].alias("nth"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    blobs = cut(findings_of(entries, rules).groupBy("blob").agg(*[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.array_sort(F.collect_list(each)).alias("all")))
    text = lambda some: F.array_join(F.transform(some, lambda x: x["span"]), ",")
    known = blobs.select("blob", *[f"n_{r.kind}" for r in BASE], text(F.filter("all", lambda x: x["nth"] < len(BASE))).alias("base"), text(F.col("all")).alias("spans"))
    none = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE]
    return paths.join(known, "blob", "left").select("doc_id", *none, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """digests() of documents. The driver's runs name no ledger, so each scans every blob; a run with a stored one scans what is new."""
    return settled(spark, lambda: digests(table(spark, sf_dir, "documents"), ledger))[0]


def redact(docs: DataFrame, mask: str = "[secret]", rules=RULES, ledger: str | None = None) -> DataFrame:
    """docs with every span of a secret replaced by the mask, and n_chars counted anew where there is one; ledger as in digests()."""
    findings = findings_of(extend(docs, ledger or new_path(docs.sparkSession), rules)[1], rules)
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = findings.withColumn("opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("blob").orderBy("start")), F.lit(0))
    cuts = cut(runs.withColumn("kept_from", before).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("kept_from", "start", "end"))).alias("cuts")))
    old = F.col("_row.text")
    joined = packed(docs, blob_of(F.col("text")).alias("blob")).join(cuts, "blob", "left")
    pieces = F.transform("cuts", lambda c: F.substring(old, c["kept_from"] + 1, c["start"] - c["kept_from"]))
    tail = F.substring(old, F.element_at("cuts", -1)["end"] + 1, F.length(old))
    masked = F.concat(F.array_join(pieces, mask), F.lit(mask), tail)
    changed = {"text": F.when(F.col("cuts").isNull(), old).otherwise(masked)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cuts").isNull(), F.col("_row.n_chars")).otherwise(F.length(masked).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _sql_rule(rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  select doc_id, unnest(range(1, len(hits) + 1)) as k, hits, tested, gaps, '{rule.kind}' as kind, {RULES.index(rule)} as nth, {rule.least} as least from (
    select doc_id, regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}', {rule.group}) as tested, regexp_split_to_array(t, '{p}') as gaps from texts
    where regexp_matches(t, '{p}'))"""


SQL = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents), raw as ({' union all '.join(map(_sql_rule, RULES))}
), placed as (
  select doc_id, kind, nth, (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0))::bigint as s, length(hits[k]) as n
  from raw where length(tested[k]) >= least
), digest as (
  select doc_id, count(*) filter (where nth = 0) as a, count(*) filter (where nth = 1) as b, count(*) filter (where nth = 2) as c,
    string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, nth) filter (where nth < 3) as base, string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, nth) as spans
  from placed group by doc_id
)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join digest using (doc_id)
"""
