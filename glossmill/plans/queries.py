"""The driver's queries over the lexicon operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import pitch, structured, text
from glossmill.operators import cards as card_ops
from glossmill.operators import catalog as catalog_ops
from glossmill.operators import consolidate as merge
from glossmill.operators import containment, enrich, fulltext, postings, prefixes, search, stats, store
from glossmill.plans import fixtures as fx
from glossmill.plans import imports, library
from glossmill.sources import archive, notes
from glossmill.sources.tables import cut, shared_folder
from glossmill.streaming import live, reactive

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


E_ = fx.ENTRIES_SQL
RANK = "case when frequency > 0 then 0 else 1 end, frequency"
ROW = "id, expression, reading, frequency"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _row(df: DataFrame, *more) -> DataFrame:
    return df.select("id", "expression", "reading", "frequency", *more)


# Lookups and searches


@query("lookup_expression", f"with {E_} select {ROW} from entries where expression = 'hot plate'")
def lookup_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(search.by_expression(fx.entries(spark, sf_dir), "hot plate"))


@query("lookup_reading", f"with {E_} select {ROW} from entries where reading = 'plate'")
def lookup_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(search.by_reading(fx.entries(spark, sf_dir), "plate"))


@query("lookup_id", f"with {E_} select {ROW} from entries where id = 42")
def lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(search.by_id(fx.entries(spark, sf_dir), 42))


def _prefix_sql(q: str) -> str:
    e, r = LOWER.format("expression"), LOWER.format("reading")
    return f"({e} like '{q.lower()}%' or {r} like '{q.lower()}%')"


def _combined_sql(q: str) -> str:
    return f"""select *, row_number() over (order by case when expression = '{q}' then 0 when reading = '{q}' then 1 else 2 end, {RANK}, length(expression), id)::int as rnk
      from entries where expression = '{q}' or reading = '{q}' or {_prefix_sql(q)} order by rnk limit 50"""


@query("search_prefix", f"with {E_} select {ROW} from entries where {_prefix_sql('pl')} order by {RANK}, length(expression), id limit 30")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(search.prefix(fx.entries(spark, sf_dir), "pl"))


def _combined(name: str, q: str) -> None:
    @query(name, f"with {E_} select {ROW}, rnk from ({_combined_sql(q)})")
    def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _row(search.combined(fx.entries(spark, sf_dir), q), "rnk")


for _name, _q in (("search_combined", "plate"), ("search_combined_expression", "hot plate"), ("search_combined_wildcard", "h_t"), ("search_combined_all", "%"), ("search_combined_case", "HOT")):
    _combined(_name, _q)


MANY = "asked as (select distinct split_part(p_name, ' ', 1) as query from part union select distinct trim(upper(p_name[:k])) from part, range(1, 6) t(k))"


@query("search_many", f"""with {E_}, {MANY}, hits as (select query, entries.*, row_number() over (partition by query order by case when expression = query then 0 when reading = query then 1 else 2 end, {RANK}, length(expression), id)::int as rnk
  from asked join entries on starts_with({LOWER.format('expression')}, {LOWER.format('query')}) or starts_with({LOWER.format('reading')}, {LOWER.format('query')})) select query, {ROW}, rnk from hits where rnk <= 50""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many queries at once: first words and beginnings of names, in capitals too."""
    part = fx.table(spark, sf_dir, "part")
    beginnings = F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.upper(F.substring("p_name", F.lit(1), k))))
    asked = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).union(part.select(beginnings))
    return search.combined_many(fx.entries(spark, sf_dir), asked).select("query", "id", "expression", "reading", "frequency", "rnk")


@query("search_blank", f"with {E_} select {ROW} from entries where false")
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(search.combined(fx.entries(spark, sf_dir), "  "))


# Consolidation


def _distinct(expr: str) -> str:
    return f"list_filter(list({expr} order by rnk), lambda x, i: list_position(list({expr} order by rnk), x) = i and trim(x) <> '')"


def _merged_sql(rows: str, by: str = "") -> str:
    return f"""lists as (
    select {by} case when trim(reading) <> '' then reading else expression end as reading,
      arg_min(struct_pack(id := id, e := expression), struct_pack(a := not regexp_matches(expression, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]'), f := case when frequency > 0 then frequency else 2147483647 end, r := rnk)) as p,
      list(expression order by rnk) as es, flatten(list(definitions order by rnk)) as ds, list(parts_of_speech order by rnk) as ps, list(id order by rnk) as ids,
      coalesce(min(frequency) filter (where frequency > 0), 0)::int as frequency, coalesce(arg_min(pitch_accent, rnk) filter (where trim(pitch_accent) <> ''), '') as pitch_accent,
      coalesce(arg_min(dictionary_name, rnk) filter (where trim(dictionary_name) <> ''), '') as dictionary_name, min(rnk)::int as first_rank
    from {rows} group by all
  ), merged as (
    select {by} p.id as primary_id, p.e as primary_expression, reading,
      array_to_string(list_filter(ds, lambda x, i: list_position(ds, x) = i), '|') as definitions,
      array_to_string(list_filter(es, lambda x, i: list_position(es, x) = i and x <> p.e), '|') as alternatives,
      frequency, pitch_accent, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), '|') as parts_of_speech, dictionary_name,
      array_to_string(ids, ',') as entry_ids, first_rank, ids
    from lists)"""


def _flat(merged: DataFrame, *by: str) -> DataFrame:
    joined = lambda c, sep, name=None: F.array_join(F.col(c).cast("array<string>"), sep).alias(name or c)
    return merged.select(*by, "primary_id", "primary_expression", "reading", joined("definitions", "|"), joined("alternative_expressions", "|", "alternatives"), "frequency", "pitch_accent", joined("parts_of_speech", "|"), "dictionary_name", joined("entry_ids", ","), "first_rank")


def _consolidated(name: str, q: str) -> None:
    @query(name, f"with {E_}, top as ({_combined_sql(q)}), {_merged_sql('top')} select * exclude (ids) from merged")
    def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(merge.consolidate(search.combined(fx.entries(spark, sf_dir), q)))


for _name, _q in (("consolidate_search", "hot"), ("consolidate_reading", "plate"), ("consolidate_all", "%")):
    _consolidated(_name, _q)


@query("consolidate_single", f"with {E_}, top as ({_combined_sql('hot')}), {_merged_sql('top')} select primary_id as id, primary_expression as expression, reading, frequency, replace(parts_of_speech, '|', ', ') as parts_of_speech from merged")
def consolidate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.single(merge.consolidate(search.combined(fx.entries(spark, sf_dir), "hot"))).select("id", "expression", "reading", "frequency", "parts_of_speech")


@query("consolidate_table", f"with {E_}, ranked as (select *, row_number() over (partition by reading order by {RANK}, id)::int as rnk from entries), {_merged_sql('ranked')} select * exclude (ids) from merged")
def consolidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(merge.consolidate_all(fx.entries(spark, sf_dir)))


@query("consolidate_japanese", f"""with {E_}, {fx.JAPANESE_SQL}, ranked as (
    select *, row_number() over (partition by case when trim(reading) <> '' then reading else expression end order by {RANK}, id)::int as rnk from japanese), {_merged_sql('ranked')},
  extras as (select case when trim(reading) <> '' then reading else expression end as key, coalesce(arg_min(audio_file, rnk) filter (where audio_file <> ''), '') as audio_file,
    coalesce(arg_min(example_sentence, rnk) filter (where trim(example_sentence) <> ''), '') as example_sentence,
    coalesce(arg_min(example_sentence_translation, rnk) filter (where trim(example_sentence) <> ''), '') as example_sentence_translation from ranked group by key)
  select merged.* exclude (ids), extras.* exclude (key) from merged join extras on key = reading""")
def consolidate_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kana and kanji of one reading, blank readings, examples and audio files."""
    merged = merge.consolidate_all(fx.japanese(spark, sf_dir))
    return _flat(merged).join(merged.select(F.col("reading").alias("_key"), "audio_file", "example_sentence", "example_sentence_translation"), F.col("reading") == F.col("_key")).drop("_key")


@query("consolidate_hot_reading", f"""with {E_}, hot as (select * replace (case when id % 2 = 0 then 'plate' else reading end as reading) from entries),
  ranked as (select *, row_number() over (partition by reading order by {RANK}, id)::int as rnk from hot), {_merged_sql('ranked')} select * exclude (ids) from merged""")
def consolidate_hot_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading that more than half of all entries have."""
    return _flat(merge.consolidate_all(fx.entries(spark, sf_dir).withColumn("reading", F.when(F.col("id") % 2 == 0, "plate").otherwise(F.col("reading")))))


DETAIL_IDS = (3, 17, 42, 99)


@query("detail_for_ids", f"""with {E_}, asked as (select unnest([3, 17, 42, 99]) as asked),
  same as (select a.asked, e.*, row_number() over (partition by a.asked order by {RANK.replace('frequency', 'e.frequency')}, e.id)::int as rnk
    from asked a join entries w on w.id = a.asked join entries e on e.reading = w.reading), {_merged_sql('same', 'asked,')}
  select asked::bigint as asked, * exclude (ids, asked) from merged where list_contains(ids, asked)""")
def detail_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in DETAIL_IDS], "id long")
    return _flat(merge.detail(fx.entries(spark, sf_dir), ids), "asked")


# Full text

TOKEN_CLASS = "0-9A-Za-z\\x{80}-\\x{10FFFF}"


def _phrase_sql(column: str, phrase: str, prefix: bool = False) -> str:
    words = f"[^{TOKEN_CLASS}]+".join(phrase.split())
    end = "" if prefix else f"($|[^{TOKEN_CLASS}])"
    return f"regexp_matches({LOWER.format(column)}, '(^|[^{TOKEN_CLASS}]){words}{end}')"


def _docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.token_table(fx.table(spark, sf_dir, "documents"), "doc_id", ("text",))


@query("fts_phrase", f"select doc_id as id from documents where {_phrase_sql('text', 'of the')}")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.match(_docs_index(spark, sf_dir), fulltext.match_query("of the"))


@query("fts_prefix", f"select doc_id as id from documents where {_phrase_sql('text', 'of th', True)}")
def fts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.match(_docs_index(spark, sf_dir), fulltext.match_query("of th"), prefix_last=True)


@query("fts_two_phrases", f"select doc_id as id from documents where {_phrase_sql('text', 'of the')} and {_phrase_sql('text', 'and')}")
def fts_two_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.match(_docs_index(spark, sf_dir), '"of the" "and"')


@query("fts_ranked_topk", f"with {E_} select {ROW} from entries where {_phrase_sql('expression', 'plate')} or {_phrase_sql('reading', 'plate')} or {_phrase_sql('definition', 'plate')} order by {RANK}, length(expression), id limit 50")
def fts_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fx.entries(spark, sf_dir)
    index = fulltext.token_table(entries, "id", ("expression", "reading", "definition"))
    return _row(fulltext.search(entries, index, fulltext.match_query("plate"), [*search.rank_keys(), F.length("expression"), "id"]))


@query("fts_after_delete", f"with {E_} select {ROW} from entries where dictionary_name <> 'Brand#11' and ({_phrase_sql('expression', 'plate')} or {_phrase_sql('reading', 'plate')} or {_phrase_sql('definition', 'plate')})")
def fts_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in the tables and the index that are published once a dictionary is deleted."""
    root = f"{shared_folder(spark)}/dictionaries/{uuid.uuid4().hex}"
    first = imports.publish(fx.entries(spark, sf_dir), fx.catalog(spark, sf_dir), root)
    entries, _, index = imports.published(spark, imports.delete_dictionary(spark, first, root, "Brand#11"))
    return _row(entries.join(fulltext.match(index, fulltext.match_query("plate")), "id", "left_semi"))


def _prefix_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return prefixes.build(fx.entries(spark, sf_dir), f"{shared_folder(spark)}/prefixes/{uuid.uuid4().hex}")


def _indexed(name: str, q: str) -> None:
    @query(name, f"with {E_} select {ROW}, rnk from ({_combined_sql(q)})")
    def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _row(prefixes.combined(spark, _prefix_paths(spark, sf_dir), q), "rnk")


for _name, _q in (("prefix_index_phrase", "hot gear"), ("prefix_index_reading", "Pla"), ("prefix_index_wildcards", "h_t %ar"), ("prefix_index_all", "%")):
    _indexed(_name, _q)


# Enrichment

LOOKUP = "last as (select p_name as k, arg_max(p_size, p_partkey) as v, arg_max(concat(p_size % 4, ',0'), p_partkey) as w from (select * replace (case when p_size % 2 = 0 then p_name else concat(p_name, '?') end as p_name) from part) group by p_name)"


def _lookup(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return enrich.last_by(fx.rank_lookup(spark, sf_dir), "expression", value, "pos")


@query("enrich_frequency", f"with {E_}, {LOOKUP} select id, coalesce(v, frequency)::int as frequency from entries left join last on k = expression")
def enrich_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.overwrite(fx.entries(spark, sf_dir), _lookup(spark, sf_dir, "rank"), "frequency").select("id", "frequency")


@query("enrich_frequency_fill", f"with {E_}, {LOOKUP} select id, (case when frequency = 0 then coalesce(v, frequency) else frequency end)::int as frequency from entries left join last on k = expression")
def enrich_frequency_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.fill(fx.entries(spark, sf_dir), _lookup(spark, sf_dir, "rank"), "frequency", 0).select("id", "frequency")


@query("enrich_pitch", f"with {E_}, {LOOKUP} select id, coalesce(w, pitch_accent) as pitch_accent from entries left join last on k = expression")
def enrich_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.overwrite(fx.entries(spark, sf_dir), _lookup(spark, sf_dir, "pitch"), "pitch_accent").select("id", "pitch_accent")


@query("enrich_pitch_fill", f"with {E_}, {LOOKUP} select id, case when pitch_accent = '' then coalesce(w, pitch_accent) else pitch_accent end as pitch_accent from entries left join last on k = expression")
def enrich_pitch_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.fill(fx.entries(spark, sf_dir), _lookup(spark, sf_dir, "pitch"), "pitch_accent", "").select("id", "pitch_accent")


# History and exports

H_, X_ = fx.SEARCH_LOG_SQL, fx.EXPORT_LOG_SQL
LAST_SEARCH = "last as (select query, max(struct_pack(t := moment, id := event_id)) as m from search_log group by query)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(fx.search_log(spark, sf_dir), ["query"], ["moment", "event_id"])


@query("history_upsert", f"with {H_}, {LAST_SEARCH} select m.id as event_id, query, m.t as moment from last")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query("history_recent", f"with {H_}, {LAST_SEARCH} select m.id as event_id, query, m.t as moment from last order by m.t desc, m.id desc limit 20")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(_history(spark, sf_dir), "moment", "event_id", store.HISTORY_LIMIT)


@query("history_gate", f"with {H_}, {LAST_SEARCH} select m.id as event_id, query, m.t as moment from last where length(query) >= 2 and query in (select concat(event_type, '-', 7) from events)")
def history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.lit("7")).alias("query"))
    return store.with_hits(_history(spark, sf_dir), hits)


@query("history_delete", f"with {H_}, {LAST_SEARCH} select m.id as event_id, query, m.t as moment from last where query <> 'click-1'")
def history_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(_history(spark, sf_dir), "query", "click-1")


LAST_EXPORT = "last as (select expression, reading, deck_name, max(struct_pack(t := moment, id := note_id)) as m from export_log group by all)"
EXPORT = "select expression, reading, deck_name, m.id as note_id, m.t as moment from last"


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(fx.export_log(spark, sf_dir), card_ops.KEYS, ["moment", "note_id"])


@query("export_upsert", f"with {X_}, {LAST_EXPORT} {EXPORT}")
def export_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports(spark, sf_dir)


@query("export_recent", f"with {X_}, {LAST_EXPORT} {EXPORT} order by m.t desc, m.id desc limit 50")
def export_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(_exports(spark, sf_dir), "moment", "note_id", store.EXPORT_LIMIT)


CANDIDATES = "candidates as (select c_custkey::varchar as expression, 'O' as reading, '1-URGENT' as deck_name from customer)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("expression"), F.lit("O").alias("reading"), F.lit("1-URGENT").alias("deck_name"))


@query("export_duplicates", f"with {X_}, {CANDIDATES} select * from candidates c where exists (select 1 from export_log x where x.expression = c.expression and x.reading = c.reading and x.deck_name = c.deck_name)")
def export_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exported(_candidates(spark, sf_dir), fx.export_log(spark, sf_dir), card_ops.KEYS)


@query("export_new_only", f"with {X_}, {CANDIDATES} select * from candidates c where not exists (select 1 from export_log x where x.expression = c.expression and x.reading = c.reading and x.deck_name = c.deck_name)")
def export_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.not_exported(_candidates(spark, sf_dir), fx.export_log(spark, sf_dir), card_ops.KEYS)


@query("deck_names", f"with {X_} select distinct deck_name from export_log")
def deck_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.export_log(spark, sf_dir).select("deck_name").distinct().orderBy("deck_name")


# Dictionaries and the catalog


@query("delete_dictionary", f"with {E_} select {ROW} from entries where dictionary_name <> 'Brand#11'")
def delete_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(store.without(fx.entries(spark, sf_dir), "dictionary_name", "Brand#11"))


@query("rename_dictionary", f"with {E_} select id, case when dictionary_name = 'Brand#11' then 'Renamed' else dictionary_name end as dictionary_name from entries")
def rename_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.rename(fx.entries(spark, sf_dir), "dictionary_name", "Brand#11", "Renamed").select("id", "dictionary_name")


@query("dictionary_counts", f"with {E_} select dictionary_name, count(*) as n from entries group by all")
def dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_value(fx.entries(spark, sf_dir), "dictionary_name")


@query("catalog_list", f"with {E_} select dictionary_name as name, count(*) as entry_count, min(id) as id, (min(id) % 3)::int as priority from entries group by all")
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.by_priority(fx.catalog(spark, sf_dir))


@query("catalog_by_name", f"with {E_} select dictionary_name as name, count(*) as entry_count, min(id) as id, (min(id) % 3)::int as priority from entries where dictionary_name = 'Brand#12' group by all")
def catalog_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.by_name(fx.catalog(spark, sf_dir), "Brand#12")


@query("catalog_upsert", f"with {E_}, listed as (select dictionary_name as name, count(*) as entry_count, min(id) as id, (min(id) % 3)::int as priority from entries group by all) select * from listed where name <> 'Brand#11' union all select 'Brand#11', 7, 1000000, 1")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("Brand#11", 7, 1_000_000, 1)], "name string, entry_count long, id long, priority int")
    return store.upsert(fx.catalog(spark, sf_dir), new, ["name"], ["id"])


KNOWN_SQL = "known as (select * from (values " + ", ".join(f"({', '.join(repr(x) for x in row)})" for row in catalog_ops.KNOWN) + ") t(id, name, category, file_size))"
_SQUEEZED = "regexp_replace(lower({}), '[ _-]', '', 'g')"


@query("catalog_known", f"""with {KNOWN_SQL}, counts as (select p_partkey % 7 as k, count(*) as n from part group by all)
  select id, k.name, file_size, coalesce(n, 0)::bigint as entry_count from (select *, row_number() over () - 1 as k from known) k left join counts using (k)""")
def catalog_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known dictionaries, each with the number of its entries that are there."""
    counts = stats.per_value(fx.named_entries(spark, sf_dir), "dictionary_name").withColumnRenamed("dictionary_name", "name")
    return catalog_ops.known(spark).join(counts, "name", "left").select("id", "name", "file_size", F.coalesce("n", F.lit(0)).alias("entry_count"))


@query("catalog_installed", f"""with {fx.ITEMS_SQL}, names as (select distinct {_SQUEEZED.format('name')} as t from there) select p_partkey, id, name from items i where exists (select 1 from names where
  contains(t, {_SQUEEZED.format('i.name')}) or contains({_SQUEEZED.format('i.name')}, t) or contains(t, replace(lower(i.id), '_', '')) or contains(replace(lower(i.id), '_', ''), t))""")
def catalog_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.installed(fx.items(spark, sf_dir), fx.names_there(spark, sf_dir)).select("p_partkey", "id", "name")


@query("catalog_installed_simple", f"""with {fx.ITEMS_SQL}, names as (select distinct lower(name) as t from there) select p_partkey, id, name from items i where exists (select 1 from names where
  contains(t, replace(i.id, '_', ' ')) or contains(t, lower(i.name)) or contains(lower(i.name), t))""")
def catalog_installed_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.installed_simple(fx.items(spark, sf_dir), fx.names_there(spark, sf_dir)).select("p_partkey", "id", "name")


@query("containing_pairs", "select distinct h.p_name as haystack, n.needle from part h, (select distinct lower(p_type) as needle from part union select distinct split_part(p_name, ' ', 2)[:k] from part, range(0, 4) t(k)) n where contains(h.p_name, n.needle)")
def containing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with the types and the beginnings of words that they contain, the empty one included."""
    part = fx.table(spark, sf_dir, "part")
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    needles = part.select(F.lower("p_type").alias("text")).union(part.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(second, F.lit(1), k)))))
    return containment.containing(part.select(F.col("p_name").alias("text")), needles)


@query("catalog_by_category", f"with {fx.ITEMS_SQL} select p_partkey, name, 'Słownik' as label from items where category = 'DICTIONARY'")
def catalog_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.of_category(fx.items(spark, sf_dir), "DICTIONARY").select("p_partkey", "name", text.category_label(F.col("category")).alias("label"))


@query("catalog_labels", f"with {fx.ITEMS_SQL} select p_partkey, case category " + " ".join(f"when '{k}' then '{v}'" for k, v in text.CATEGORY_LABELS.items()) + " end as label from items")
def catalog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.items(spark, sf_dir).select("p_partkey", text.category_label(F.col("category")).alias("label"))


LISTED = "listed as (select dictionary_name as name, count(*) as entry_count, min(id) as id, (min(id) % 3)::int as priority from entries group by all)"


@query("catalog_update", f"with {E_}, {LISTED} select name, entry_count, id, (case when id = (select min(id) from listed) then 99 else priority end)::int as priority from listed")
def catalog_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the least id gets another priority."""
    listed = fx.catalog(spark, sf_dir)
    return catalog_ops.changed(listed, listed.agg(F.min("id")).first()[0], priority=99)


@query("catalog_delete_by_id", f"with {E_}, {LISTED} select * from listed where id <> (select max(id) from listed)")
def catalog_delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = fx.catalog(spark, sf_dir)
    return store.without(listed, "id", listed.agg(F.max("id")).first()[0])


@query("catalog_delete_by_name", f"with {E_}, {LISTED} select * from listed where name <> 'Brand#12'")
def catalog_delete_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(fx.catalog(spark, sf_dir), "name", "Brand#12")


@query("export_delete_all", f"with {X_} select count(*) as n from export_log where false")
def export_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.emptied(_exports(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("export_forced", f"with {E_}, {X_} select id, expression as front from entries")
def export_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all entries, whether the deck has them or not."""
    return card_ops.export(fx.entries(spark, sf_dir), fx.export_log(spark, sf_dir), "1-URGENT", force=True)[0].select("id", "front")


@query("encode_definitions", f"with {E_} select id, definition as encoded from entries")
def encode_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.entries(spark, sf_dir).select("id", text.encode_list(F.col("definitions")).alias("encoded"))


@query("has_dictionaries", f"with {E_} select count(*) > 0 as found from entries")
def has_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.catalog(spark, sf_dir).agg((F.count(F.lit(1)) > 0).alias("found"))


# Statistics

COUNTS = f"""(select count(*) from part) as entries, (select count(distinct p_brand) from part) as dictionaries,
  (select count(*) from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders)) as exports, (select count(distinct query) from search_log) as searches"""


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(entries=fx.entries(spark, sf_dir), dictionaries=fx.catalog(spark, sf_dir), exports=_exports(spark, sf_dir), searches=_history(spark, sf_dir))


@query("stats_overview", f"with {H_} select {COUNTS}")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir)


def _number_sql(n: str) -> str:
    tenth = lambda unit: f"(({n} + {unit // 20}) // {unit // 10})"
    shown = lambda unit, mark: f"concat({tenth(unit)} // 10, '.', {tenth(unit)} % 10, '{mark}')"
    return f"case when {n} >= 1000000 then {shown(1000000, 'M')} when {n} >= 1000 then {shown(1000, 'K')} else {n}::varchar end"


@query("stats_formatted", f"with {H_}, counts as (select {COUNTS}) select " + ", ".join(f"{_number_sql(c)} as {c}" for c in ("entries", "dictionaries", "exports", "searches")) + " from counts")
def stats_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir).select(*[text.format_number(F.col(c)).alias(c) for c in ("entries", "dictionaries", "exports", "searches")])


# Scalar functions

LABEL_SQL = "case when {0} <= 0 then '' " + " ".join(f"when {{0}} <= {n} then '{name}'" for n, name in text.FREQUENCY_LABELS) + " else concat('#', {0}) end"


@query("frequency_label", f"select o_orderkey as id, {LABEL_SQL.format('o_orderkey')} as label from orders")
def frequency_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.frequency_label(F.col("o_orderkey")).alias("label"))


@query("display_text", f"with {E_} select id, case when id % 4 = 0 then reading else expression end as shown, case when reading <> expression then reading end as extra from entries")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.entries(spark, sf_dir)
    return e.select("id", text.display_text(F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("expression")), F.col("reading")).alias("shown"), text.shown_reading(F.col("reading"), F.col("expression")).alias("extra"))


@query("definitions", f"with {E_} select id, concat(p_type, '; ', p_brand) as plain, concat('1. ', p_type, '; 2. ', p_brand) as numbered, p_type as first, 1 as more from entries")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.entries(spark, sf_dir)
    some = text.first_definitions(F.col("definitions"), 1)
    return e.select("id", text.definitions_plain(F.col("definitions")).alias("plain"), text.definitions_numbered(F.col("definitions")).alias("numbered"), F.array_join(some["shown"], "; ").alias("first"), some["more"].alias("more"))


@query("definitions_short", "select doc_id, case when length(text) > 120 then concat(substr(text, 1, 117), '...') else text end as short from documents")
def definitions_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"))


@query("decode_definitions", f"with {E_} select id, case when id % 2 = 0 then concat(p_type, '|', p_brand) else parts_of_speech end as decoded, case when id % 2 = 0 then 2 else 0 end as listed from entries")
def decode_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("id") % 2 == 0, F.col("definition")).otherwise(F.col("parts_of_speech"))
    return fx.entries(spark, sf_dir).select("id", F.array_join(text.decode_definitions(stored), "|").alias("decoded"), F.size(text.decode_list(stored)).alias("listed"))


def _nested(sql: str, pairs) -> str:
    for a, b in pairs:
        sql = f"replace({sql}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return sql


@query("escape_html", f"select page_id, {_nested('html', text.HTML_ENTITIES)} as escaped from pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("sanitize_like", "select page_id, replace(replace(replace(trim(url), '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped from pages")
def sanitize_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", text.escape_like(F.col("url")).alias("escaped"))


@query("sanitize_deck", """select page_id, case when trim(d) = '' then 'Mining Deck' else d end as deck from
  (select page_id, substr(regexp_replace(trim(html, E' \\n\\t\\r'), '[<>"'';&|`$\\\\]', '', 'g'), 1, 200) as d from pages)""")
def sanitize_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", text.deck_name(F.col("html")).alias("deck"))


@query("sanitize_file", "select page_id, substr(replace(replace(replace(url, '..', ''), '/', ''), '\\', ''), 1, 255) as file from pages")
def sanitize_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("file"))


@query("format_number", f"select o_orderkey as id, {_number_sql('(o_orderkey * 37)')} as shown from orders")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.format_number(F.col("o_orderkey") * 37).alias("shown"))


@query("format_bytes", """select doc_id, case when n >= 1048576 then concat((n * 10 + 524288) // 1048576 // 10, '.', (n * 10 + 524288) // 1048576 % 10, ' MB')
  when n >= 1024 then concat((n + 512) // 1024, ' KB') else concat(n, ' B') end as shown from (select doc_id, n_chars * 37 as n from documents)""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.format_bytes(F.col("n_chars") * 37).alias("shown"))


@query("format_date", "select event_id, strftime(ts, '%d.%m.%Y %H:%M') as shown from events")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", text.format_date(F.col("ts")).alias("shown"))


@query("progress", "select conv_id, turn, case when turn > 0 then (turn - 1) / turn else 0 end::double as done from conversations")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.progress(F.col("turn") - 1, F.col("turn")).alias("done"))


MORAE_SQL = f"regexp_extract_all(reading, '(?s).[{pitch.JOINED}]*')"
COUNTED = f"{fx.KANA_SQL}, counted as (select id, len({MORAE_SQL})::int as n, d from words)"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.kana_words(spark, sf_dir).select("id", F.size(pitch.morae(F.col("reading"))).alias("n"), "d")


@query("morae", f"with {fx.KANA_SQL} select id, array_to_string({MORAE_SQL}, '|') as morae, len({MORAE_SQL})::int as n from words")
def morae(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = pitch.morae(F.col("reading"))
    return fx.kana_words(spark, sf_dir).select("id", F.array_join(units, "|").alias("morae"), F.size(units).alias("n"))


@query("pitch_pattern", f"""with {COUNTED} select id, case when n = 0 then '' when n = 1 then case when d <> 0 then 'H' else 'L' end
  else array_to_string(list_transform(range(0, n), lambda i: case when (d = 0 and i > 0) or (d = 1 and i = 0) or (d > 1 and i > 0 and i < d) then 'H' else 'L' end), '') end as pattern from counted""")
def pitch_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(pitch.pitch_pattern(F.col("n"), F.col("d")), lambda h: F.when(h, "H").otherwise("L")), "")
    return _counted(spark, sf_dir).select("id", shown.alias("pattern"))


@query("pitch_label", f"with {COUNTED} select id, case when d = 0 then '平板' when d = 1 then '頭高' when d = n then '尾高' else '中高' end as label from counted")
def pitch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("id", pitch.pitch_label(F.col("n"), F.col("d")).alias("label"))


@query("pitch_positions", f"with {fx.KANA_SQL} select id, array_to_string(list_filter(list_transform(string_split(listed, ','), lambda x: try_cast(trim(x) as int)), lambda x: x is not null), ',') as positions from words")
def pitch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.kana_words(spark, sf_dir).select("id", F.array_join(pitch.positions(F.col("listed")).cast("array<string>"), ",").alias("positions"))


def _pitch_html_sql(rows: str) -> str:
    """(key, html) of rows(key, reading, listed): a row per accent and mora, put together again in order."""
    high = "case when n = 1 then d <> 0 when d = 0 then {0} > 0 when d = 1 then {0} = 0 else {0} > 0 and {0} < d end"
    return f"""units as (
  select key, {MORAE_SQL} as units, list_filter(list_transform(string_split(listed, ','), lambda x: try_cast(trim(x) as int)), lambda x: x is not null) as drops from ({rows})
), accents as (select key, units, len(units) as n, unnest(drops) as d, unnest(range(1, len(drops) + 1)) as k from units
), placed as (select key, n, d, k, unnest(units) as mora, unnest(range(0, n)) as i from accents
), marked as (select *, {high.format("i")} as high, {high.format("(i + 1)")} as following from placed
), spans as (
  select key, k, concat('<span style="{pitch.LABEL_STYLE}">[', any_value(d), '] ', any_value(case when d = 0 then '平板' when d = 1 then '頭高' when d = n then '尾高' else '中高' end), '</span> ',
    string_agg(concat('<span style="', case when high then '{pitch.HIGH_STYLE}' else '{pitch.LOW_STYLE}' end,
      case when i = n - 1 or high = following then '' when high then '{pitch.FALL_STYLE}' else '{pitch.RISE_STYLE}' end, ' display:inline-block;">', mora, '</span>'), '' order by i)) as html
  from marked group by key, k
), pitched as (select key, string_agg(html, '&nbsp;&nbsp;' order by k) as html from spans group by key)"""


@query("pitch_html", f"with {fx.KANA_SQL}, {_pitch_html_sql('select id as key, reading, listed from words')} select id, coalesce(html, '') as html from words left join pitched on key = id")
def pitch_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.kana_words(spark, sf_dir).select("id", pitch.pitch_html(F.col("reading"), F.col("listed")).alias("html"))


@query("cards", f"with {E_} select id, expression as front, reading, concat(p_type, '<br>', p_brand) as meaning, {LABEL_SQL.format('frequency')} as frequency, '' as audio, '' as sentence from entries")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.cards(fx.entries(spark, sf_dir)).drop("pitch_accent")


@query("cards_pitch", f"with {E_}, {_pitch_html_sql('select id as key, reading, pitch_accent as listed from entries')} select id, coalesce(html, '') as pitch_accent from entries left join pitched on key = id")
def cards_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.cards(fx.entries(spark, sf_dir)).select("id", "pitch_accent")


@query("deck_notes", f"""with {E_}, cards as (select expression, reading, min(struct_pack(f := expression, m := concat(p_type, '<br>', p_brand), q := {LABEL_SQL.format('frequency')})) as c from entries group by all)
  select d.name, expression, reading, c.f as front from cards, (values ('Deck'), ('Other')) d(name)""")
def deck_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in two decks. The first export runs twice and adds nothing the second time; a note is in a deck once."""
    path = f"{shared_folder(spark)}/notes/{uuid.uuid4().hex}"
    made = card_ops.cards(fx.entries(spark, sf_dir), F.col("expression").alias("_expression"), F.col("reading").alias("_reading"))
    rows = made.select(F.col("_expression").alias("expression"), F.col("_reading").alias("reading"), *[F.col(c).alias(f"field_{c}") for c in card_ops.FIELDS])
    for deck, export in (("Deck", "a"), ("Deck", "a"), ("Other", "b")):
        notes.export_notes(rows, path, deck, export)
    return notes.notes(spark, path).select("name", "expression", "reading", F.col("field_front").alias("front"))


# Nested JSON

@query("parse_frequency", """select p_partkey as id, (case when p_partkey % 9 in (0, 1, 2, 3, 4, 5) then p_size when p_partkey % 9 = 6 then 1000 + p_size else 0 end)::int as parsed from part""")
def parse_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks as a number, a text, in objects of several kinds, with a thousands separator, and in no usable form."""
    forms = ("%s", '"#%s"', '{"value":%s}', '{"frequency":{"value":%s}}', '{"reading":"x","frequency":"%s"}', '{"displayValue":"%s x"}', None, "[%s]", '{"value":{"n":%s}}')
    size = F.col("p_size").cast("string")
    payload = F.format_string('"1,%s"', F.lpad(size, 3, "0"))
    for k, form in enumerate(forms):
        if form:
            payload = F.when(F.col("p_partkey") % len(forms) == k, F.format_string(form, size)).otherwise(payload)
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), structured.frequency(payload).alias("parsed"))


@query("parse_pitch", """select p_partkey as id, case p_partkey % 4 when 0 then concat(p_size, ',0') when 1 then '3' else '' end as parsed from part""")
def parse_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents: two positions, a position beside one that is no number, an accent that is no object, and none at all."""
    forms = ('{"pitches":[{"position":%s},{"position":0}]}', '{"pitches":[{"position":3},{"position":"H%s"}]}', '{"pitches":[%s]}', '{"pitch":[{"position":%s}]}')
    payload = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        payload = F.when(F.col("p_partkey") % len(forms) == k, F.format_string(form, F.col("p_size").cast("string"))).otherwise(payload)
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), structured.pitch(payload).alias("parsed"))


@query("structured_text", """select p_partkey as id, case p_partkey % 4 when 0 then concat(p_type, '; ', p_brand) when 1 then concat(p_type, ', ', p_brand) when 2 then p_name else concat('{"type":"image","path":"', p_brand, '"}') end as parsed from part""")
def structured_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, ruby, deep nesting and an image."""
    deep = '{"type":"structured-content","content":' + '{"tag":"div","content":[' * 40 + '"%s"' + "]}" * 40 + "}"
    forms = (
        ('{"type":"structured-content","content":{"tag":"ul","content":[{"tag":"li","content":"%s"},{"tag":"li","content":"%s"}]}}', ("p_type", "p_brand")),
        ('{"type":"structured-content","content":{"tag":"ruby","content":["%s",{"tag":"rt","content":"%s"}]}}', ("p_type", "p_brand")),
        (deep, ("p_name",)),
        ('{"type":"image","path":"%s"}', ("p_brand",)),
    )
    payload = F.lit(None).cast("string")
    for k, (form, columns) in enumerate(forms):
        payload = F.when(F.col("p_partkey") % len(forms) == k, F.format_string(form, *columns)).otherwise(payload)
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), structured.structured_text(payload).alias("parsed"))


# Archives


@query("import_entries", f"with {fx.ARCHIVE_SQL} select * from imported")
def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(imports.import_archives(fx.archive_members(spark, sf_dir))[0])


def _imported(entries: DataFrame) -> DataFrame:
    return entries.select("id", "expression", "reading", F.array_join("definitions", "|").alias("definitions"), "frequency", "pitch_accent", "parts_of_speech", "dictionary_name", "sequence_number")


@query("import_catalog", f"with {fx.ARCHIVE_SQL} select p_brand as name, '3' as version, 'r1' as revision, coalesce(n, 0)::bigint as entry_count, true as enabled, 0 as priority from (select distinct p_brand from part) left join (select dictionary_name as d, count(*) as n from imported group by d) on d = p_brand")
def import_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_archives(fx.archive_members(spark, sf_dir))[1]


@query("import_archive_files", f"with {fx.ARCHIVE_SQL} select * from imported")
def import_archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import of ZIP files, which tasks have written from the same members, a task a member."""
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    archive.write(fx.archive_members(spark, sf_dir), folder).collect()
    return _imported(imports.import_archives(archive.streamed(spark, folder))[0])


@query("archive_parts", """select concat(p_brand, '.zip') as path, count(distinct floor((p_partkey - 1) / 500))::bigint as banks, count(*)::bigint as terms, (2 * count(*))::bigint as meta from part group by all""")
def archive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the ZIP files: their term banks, and the elements of both kinds of banks."""
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    archive.write(fx.archive_members(spark, sf_dir), folder).collect()
    count = lambda condition: F.count(F.when(F.expr(condition), 1))
    name = F.element_at(F.split("path", "/"), -1)
    return archive.streamed(spark, folder).groupBy(name.alias("path")).agg(count("kind = 'terms' and pos < 0").alias("banks"), count("kind = 'terms' and pos >= 0").alias("terms"), count("kind = 'meta' and pos >= 0").alias("meta"))


META_ONLY = "listed as (select p_brand, count(distinct p_name) as pitches, count(distinct p_name) filter (where p_partkey % 5 <> 0) as ranks, count(*) filter (where p_partkey % 7 <> 0 and p_partkey % 13 <> 0) as n from part group by all)"


@query("import_meta_only", f"with {META_ONLY} select p_brand as name, (case when p_brand like '%1' then ranks + pitches else n end)::bigint as entry_count, p_brand like '%1' as meta_only from listed")
def import_meta_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog where archives of some brands have meta banks only: their count is of the ranks and accents that they set."""
    members = fx.archive_members(spark, sf_dir).filter(~(F.col("path").endswith("1.zip") & (F.col("kind") == "terms")))
    _, catalog = imports.import_archives(members)
    return catalog.select("name", "entry_count").join(archive.index(members).select(F.col("title").alias("name"), "meta_only"), "name")


# A library in versions

LIBRARY_SQL = """batched as (select *, case when p_brand like '%1' then 2 else 1 end as batch from part
), usable as (select *, p_partkey % 3 as kind from batched where p_partkey % 7 <> 0 and p_partkey % 13 <> 0
), ranks as (
  select batch, p_name as k, arg_max(p_size, struct_pack(b := p_brand, p := p_partkey)) filter (where p_partkey % 5 <> 0) as rank,
    arg_max(concat(p_size % 5, ',0'), struct_pack(b := p_brand, p := p_partkey)) as pitch from batched group by all
), imported as (
  select row_number() over (order by u.batch, p_brand, p_partkey) as id, p_name as expression, case when p_partkey % 4 = 0 then p_name else split_part(p_name, ' ', 2) end as reading,
    case kind when 2 then concat(p_type, '; ', p_brand) else concat(p_type, '|', p_brand) end as definitions,
    coalesce(second.rank, case when u.batch = 1 then first.rank end, 0)::int as frequency, coalesce(second.pitch, case when u.batch = 1 then first.pitch end, '') as pitch_accent,
    'n, v, P' as parts_of_speech, p_brand as dictionary_name, p_partkey::int as sequence_number
  from usable u left join ranks first on first.batch = 1 and first.k = p_name left join ranks second on second.batch = 2 and second.k = p_name
), kept as (select * from imported where dictionary_name <> 'Brand#11')"""


def _library(spark: SparkSession, sf_dir: str) -> str:
    """A library of three versions: most archives, those whose names end with a 1 as well, and all but one dictionary."""
    root, members = f"{shared_folder(spark)}/libraries/{uuid.uuid4().hex}", fx.archive_members(spark, sf_dir)
    second = F.col("path").endswith("1.zip")
    for change in (lambda: library.add(spark, root, members.filter(~second)), lambda: library.add(spark, root, members.filter(second)), lambda: library.delete(spark, root, "Brand#11")):
        result = change()
        if not result.success:
            raise RuntimeError(result.error)
    return root


@query("library_entries", f"with {LIBRARY_SQL} select * from kept")
def library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(library.entries(spark, _library(spark, sf_dir)))


@query("library_first_version", f"with {LIBRARY_SQL} select id, expression, dictionary_name, coalesce(rank, 0)::int as frequency from imported left join ranks on batch = 1 and k = expression where dictionary_name not like '%1'")
def library_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first version held, read when there are newer ones."""
    return library.entries(spark, _library(spark, sf_dir), 1).select("id", "expression", "dictionary_name", "frequency")


@query("library_catalog", f"with {LIBRARY_SQL} select p_brand as name, coalesce(n, 0)::bigint as entry_count from (select distinct p_brand from part) left join (select dictionary_name as d, count(*) as n from imported group by d) on d = p_brand where p_brand <> 'Brand#11'")
def library_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.catalog(spark, _library(spark, sf_dir)).select("name", "entry_count")


@query("library_find", f"with {LIBRARY_SQL} select {ROW} from kept where {_phrase_sql('expression', 'gear')} or {_phrase_sql('reading', 'gear')} order by {RANK}, length(expression), id limit 50")
def library_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in an index that has followed two imports and a delete."""
    return _row(library.find(spark, _library(spark, sf_dir), "gear"))


@query("library_index", f"with {LIBRARY_SQL} select id from kept where {_phrase_sql('definitions', 'economy brand')} or {_phrase_sql('expression', 'hot gear')}")
def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in the segments and tombstones, without a limit."""
    root = _library(spark, sf_dir)
    tokens = postings.tokens(spark, library.index(spark, root))
    return fulltext.match(tokens, '"economy brand"').union(fulltext.match(tokens, '"hot gear"')).distinct()


@query("library_merged_index", f"with {LIBRARY_SQL} select id from kept where {_phrase_sql('definitions', 'economy brand')}")
def library_merged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the one segment that is left when the library is tidied up."""
    root = _library(spark, sf_dir)
    library.tidy(spark, root)
    return fulltext.match(postings.tokens(spark, library.index(spark, root)), '"economy brand"')


@query("library_emissions", f"""with {LIBRARY_SQL}, names as (select distinct batch, p_brand as name from batched), sizes as (select dictionary_name as name, count(*) as n from imported group by all),
  touched as (select 1 as version, name from names where batch = 1 union select 2, name from names where batch = 2
    union select 2, dictionary_name from imported where dictionary_name not like '%1' and expression in (select p_name from batched where batch = 2))
  select version::bigint as version, name, coalesce(n, 0)::bigint as n from touched left join sizes using (name) union all select 3, 'Brand#11', 0""")
def library_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the dictionaries that each version has changed, as a stream over the versions tells them."""
    root = _library(spark, sf_dir)

    def sizes(version: int, names: list[str]) -> DataFrame:
        asked = spark.createDataFrame([(n,) for n in names], "name string")
        counts = stats.per_value(library.entries(spark, root, version).filter(F.col("dictionary_name").isin(names)), "dictionary_name")
        return asked.join(counts.withColumnRenamed("dictionary_name", "name"), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))

    path = live.follow(spark, root, _stream_root(spark), sizes)
    return spark.read.schema("name string, n long, version long").parquet(path).select("version", "name", "n")


# Search input

K_ = "keystrokes as (select user_id, ts, event_id, event_type as value from events)"
DEBOUNCED = "calm as (select * exclude (following) from (select *, lead(ts) over (partition by user_id order by ts, event_id) as following from keystrokes) where following is null or following >= ts + interval 30 minutes)"


@query("debounce_events", f"with {K_}, {DEBOUNCED} select * from calm")
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactive.debounce(fx.keystrokes(spark, sf_dir), "user_id", "ts", "event_id")


@query("debounce_distinct", f"with {K_}, {DEBOUNCED} select * exclude (before) from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from calm) where before is null or value <> before")
def debounce_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = reactive.debounce(fx.keystrokes(spark, sf_dir), "user_id", "ts", "event_id")
    return reactive.distinct_until_changed(calm, "user_id", "ts", "event_id", "value")


HOT_K = "keystrokes as (select case when event_id % 2 = 0 then -1 else user_id end as user_id, ts, event_id, event_type as value from events)"


@query("debounce_hot_user", f"with {HOT_K}, {DEBOUNCED} select * from calm")
def debounce_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user who has half of all events."""
    return reactive.debounce(_hot_keystrokes(spark, sf_dir), "user_id", "ts", "event_id", spread=True)


@query("distinct_hot_user", f"with {HOT_K} select * exclude (before) from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from keystrokes) where before is null or value <> before")
def distinct_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactive.distinct_until_changed(_hot_keystrokes(spark, sf_dir), "user_id", "ts", "event_id", "value", spread=True)


def _hot_keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.keystrokes(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id")).cast("long"))


@query("latest_queries", f"with {K_} select user_id, arg_max(value, struct_pack(t := ts, e := event_id)) as value from keystrokes group by user_id")
def latest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactive.latest_queries(fx.keystrokes(spark, sf_dir), "user_id", "ts", "event_id", "value")


def _stream_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _keystroke_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactive.read_stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("value"))


@query("stream_debounce", f"with {K_}, {DEBOUNCED} select user_id, ts::timestamp as ts, event_id, value from calm where ts + interval 90 minutes <= (select max(ts) from keystrokes)")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = reactive.stream_debounce(_keystroke_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")
    return spark.read.schema(calm.schema).parquet(reactive.run_available(calm, _stream_root(spark))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_distinct", f"with {K_} select user_id, ts::timestamp as ts, event_id, value from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from keystrokes) where before is null or value <> before")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = reactive.stream_distinct(_keystroke_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")
    return spark.read.schema(changed.schema).parquet(reactive.run_available(changed, _stream_root(spark))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("live_debounce", f"with {K_}, {DEBOUNCED} select user_id, ts::timestamp as ts, event_id, value from calm")
def live_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by keyed state and timers: each user's last one is told without later input."""
    root = _stream_root(spark)
    calm = live.debounce(_keystroke_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")
    live.run_until_quiet(live.start(calm, root))
    return spark.read.schema(calm.schema).parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("live_results", f"""with {K_}, last as (select user_id, arg_max(value, struct_pack(t := ts, e := event_id)) as value from keystrokes group by user_id)
  select user_id, coalesce(value, '') as value from (select user_id from keystrokes union select c_custkey from customer) left join last using (user_id)""")
def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest query of each user in a table that a stream keeps, and an empty one for customers without any."""
    root, keys, order = _stream_root(spark), ["user_id"], ["ts", "event_id"]
    stream = live.latest(_keystroke_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")
    live.run_until_quiet(live.start(stream, root, lambda batch, n: live.put_batch(batch, n, f"{root}/table", keys, order)))
    users = fx.table(spark, sf_dir, "events").select("user_id").union(fx.table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    return live.observed(users, live.results(spark, f"{root}/table", stream.schema, keys, order), keys, {"value": ""})


TYPED = "typed as (select user_id, ts, event_id, ['small ring', 'bolt', 'Hot', 'zzz', 'r'][(event_id % 5 + 1)::int] as value from events)"
LAST_TYPED = f"{TYPED}, last as (select user_id, arg_max(value, struct_pack(t := ts, e := event_id)) as value from typed group by user_id)"


def _typed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("small ring", "bolt", "Hot", "zzz", "r")])
    return _keystroke_stream(spark, sf_dir).withColumn("value", F.element_at(words, (F.col("event_id") % 5 + 1).cast("int")))


def _searched(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Runs the search screen as a stream: each user's latest query is searched, merged by reading, and kept in the history if it found something."""
    entries = fx.entries(spark, sf_dir)
    stream = live.latest(_typed_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")

    def each(batch: DataFrame, number: int) -> None:
        batch = cut(batch.withColumnRenamed("value", "query"))
        found = cut(merge.consolidate(search.combined_many(entries, batch), ("query",)))
        shown = batch.join(found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min_by("primary_expression", "first_rank").alias("best")), "query", "left")
        live.put_batch(shown.select("user_id", "ts", "event_id", "query", F.coalesce("n", F.lit(0)).alias("n"), "best"), number, f"{root}/results", ["user_id"], ["ts", "event_id"])
        kept = store.with_hits(batch.select("query", "ts", "event_id"), found)
        live.put_batch(kept.select("query", "ts", "event_id"), number, f"{root}/history", ["query"], ["ts", "event_id"])

    live.run_until_quiet(live.start(stream, root, each))


@query("live_search", f"""with {E_}, {LAST_TYPED}, asked as (select distinct value as query from last), hits as (select query, entries.*, row_number() over (partition by query
  order by case when expression = query then 0 when reading = query then 1 else 2 end, {RANK}, length(expression), id)::int as rnk
  from asked join entries on starts_with(expression, {LOWER.format('query')}) or starts_with(reading, {LOWER.format('query')})), {_merged_sql('(select * from hits where rnk <= 50)', 'query,')},
  shown as (select query, count(*) as n, arg_min(primary_expression, first_rank) as best from merged group by query)
  select user_id, value as query, coalesce(n, 0)::bigint as n, best from last left join shown on query = value""")
def live_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user sees at the end: the number of merged records of the latest query, and the first of them."""
    root = _stream_root(spark)
    _searched(spark, sf_dir, root)
    return live.results(spark, f"{root}/results", "user_id long, ts timestamp, event_id long, query string, n long, best string", ["user_id"], ["ts", "event_id"]).select("user_id", "query", "n", "best")


@query("live_search_history", f"""with {TYPED}, last as (select user_id, arg_max(value, struct_pack(t := ts, e := event_id)) as query, max(struct_pack(t := ts, e := event_id)) as place from typed group by user_id)
  select query, (max(place)).e as event_id from last where query in ('small ring', 'bolt', 'Hot') group by query""")
def live_search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side effect of the same stream: queries of two characters or more that found something, with their last event."""
    root = _stream_root(spark)
    _searched(spark, sf_dir, root)
    return live.results(spark, f"{root}/history", "query string, ts timestamp, event_id long", ["query"], ["ts", "event_id"]).select("query", "event_id")


@query("live_caught", f"with {K_}, last as (select user_id, arg_max(value, struct_pack(t := ts, e := event_id)) as value from keystrokes group by user_id) select user_id, case when user_id = (select min(user_id) from keystrokes) then '' else value end as value from last")
def live_caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that fails for one user: that one gets the empty result, all others theirs, and the stream goes on."""
    root, keys, order = _stream_root(spark), ["user_id"], ["ts", "event_id"]
    failing = fx.table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    fails = lambda rows: rows.withColumn("value", F.when(F.col("user_id") == failing, F.raise_error(F.lit("no result")).cast("string")).otherwise(F.col("value")))
    stream = live.latest(_keystroke_stream(spark, sf_dir), "user_id", "ts", "event_id", "value")

    def each(batch: DataFrame, number: int) -> None:
        found = live.caught(batch, fails, "user_id", lambda rows: rows.withColumn("value", F.lit("")))
        live.put_batch(reduce(DataFrame.union, found), number, f"{root}/table", keys, order)

    live.run_until_quiet(live.start(stream, root, each))
    return live.results(spark, f"{root}/table", stream.schema, keys, order).select("user_id", "value")
