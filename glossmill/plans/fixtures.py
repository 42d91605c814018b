"""Lexicon tables over the driver's tables, so that each operator can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import decode_definitions
from glossmill.sources.archive import member_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    none = F.lit("")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("expression"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("reading"),
        F.concat(F.lit('["'), "p_type", F.lit('","'), "p_brand", F.lit('"]')).alias("definition"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).alias("frequency"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise((F.col("p_size") % 7).cast("string")).alias("pitch_accent"),
        F.col("p_type").alias("parts_of_speech"),
        F.col("p_brand").alias("dictionary_name"),
        F.col("p_partkey").cast("int").alias("sequence_number"),
        none.alias("example_sentence"),
        none.alias("example_sentence_translation"),
        none.alias("audio_file"),
    ).withColumn("definitions", decode_definitions(F.col("definition")))


ENTRIES_SQL = """entries as (
  select p_partkey as id, p_name as expression, split_part(p_name, ' ', 2) as reading, p_type, p_brand,
    concat('["', p_type, '","', p_brand, '"]') as definition, [p_type, p_brand] as definitions,
    (case when p_size % 5 = 0 then 0 else p_size end)::int as frequency,
    case when p_partkey % 3 = 0 then '' else (p_size % 7)::varchar end as pitch_accent,
    p_type as parts_of_speech, p_brand as dictionary_name, p_partkey::int as sequence_number
  from part)"""


def japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of 40 readings, some blank, with kana and kanji, examples and audio files."""
    k, blank = (F.col("p_partkey") % 40).cast("string"), F.lit("")
    of = lambda text: F.concat(F.lit(text), k)
    return entries(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("id") == F.col("p_partkey")).select(
        "id",
        F.when(F.col("id") % 4 == 0, of("食")).when(F.col("id") % 4 == 1, of("タベ")).when(F.col("id") % 4 == 2, of("かな")).otherwise(of("〆")).alias("expression"),
        F.when(F.col("id") % 11 == 0, " ").otherwise(of("かな")).alias("reading"),
        "definitions", "frequency", "pitch_accent", "parts_of_speech", "dictionary_name",
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("例 "), "p_name")).when(F.col("p_size") % 3 == 1, " ").otherwise(blank).alias("example_sentence"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ex "), F.col("p_size").cast("string"))).otherwise(blank).alias("example_sentence_translation"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.col("id").cast("string"), F.lit(".mp3"))).otherwise(blank).alias("audio_file"),
    )


JAPANESE_SQL = """japanese as (
  select e.* exclude (expression, reading), concat(case id % 4 when 0 then '食' when 1 then 'タベ' when 2 then 'かな' else '〆' end, id % 40) as expression,
    case when id % 11 = 0 then ' ' else concat('かな', id % 40) end as reading,
    case p_size % 3 when 0 then concat('例 ', p_name) when 1 then ' ' else '' end as example_sentence,
    case when p_size % 2 = 0 then concat('ex ', p_size) else '' end as example_sentence_translation,
    case when p_size % 7 = 0 then concat(id, '.mp3') else '' end as audio_file
  from entries e join part on id = p_partkey)"""


# Letters stand for kana in the order of both, the last ones for characters that join the mora before them.
LETTERS, KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにゃゅっー"


def kana_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in kana and lists of accents, some of whose parts are no numbers; every seventeenth reading is empty."""
    part = table(spark, sf_dir, "part")
    spelt = F.translate(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), LETTERS, KANA)
    listed = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.concat((F.col("p_size") % 4).cast("string"), F.lit(", x,"), (F.col("p_size") % 9).cast("string"))).otherwise((F.col("p_size") % 12).cast("string"))
    return part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 17 == 0, "").otherwise(spelt).alias("reading"), listed.alias("listed"), (F.col("p_size") % 12).cast("int").alias("d"))


KANA_SQL = f"""words as (select p_partkey as id, case when p_partkey % 17 = 0 then '' else translate(replace(p_name, ' ', ''), '{LETTERS}', '{KANA}') end as reading,
  case p_partkey % 5 when 0 then '' when 1 then concat(p_size % 4, ', x,', p_size % 9) else (p_size % 12)::varchar end as listed, (p_size % 12)::int as d from part)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of things that can be had: all parts, in four categories, those of odd keys with the name in the id alone."""
    part = table(spark, sf_dir, "part")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("p_size") % len(CATEGORIES) + 1).cast("int"))
    odd = F.col("p_partkey") % 2 == 1
    return part.select("p_partkey", F.when(odd, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit("p_"), F.col("p_partkey").cast("string"))).alias("id"), F.when(odd, "-").otherwise(F.initcap("p_name")).alias("name"), category.alias("category"))


def names_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what is there: types of parts and single words of their names, some within names of items, some around them."""
    part = table(spark, sf_dir, "part")
    return part.filter("p_size % 3 = 0").select(F.col("p_type").alias("name")).union(part.filter("p_size = 7").select(F.concat(F.lit("The "), "p_name", F.lit(" No-1"))))


CATEGORIES = ("DICTIONARY", "KANJI", "FREQUENCY", "PITCH_ACCENT")
ITEMS_SQL = """items as (select p_partkey, case when p_partkey % 2 = 1 then replace(p_name, ' ', '_') else concat('p_', p_partkey) end as id,
  case when p_partkey % 2 = 1 then '-' else concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), ' ', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) end as name,
  case p_size % 4 when 0 then 'DICTIONARY' when 1 then 'KANJI' when 2 then 'FREQUENCY' else 'PITCH_ACCENT' end as category from part),
there as (select p_type as name from part where p_size % 3 = 0 union all select concat('The ', p_name, ' No-1') from part where p_size = 7)"""


def named_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of dictionaries that are called as known ones, and of one that is not."""
    from glossmill.operators.catalog import KNOWN

    names = F.array(*[F.lit(k[1]) for k in KNOWN], F.lit("Own"))
    return entries(spark, sf_dir).withColumn("dictionary_name", F.element_at(names, (F.col("sequence_number") % (len(KNOWN) + 1) + 1).cast("int")))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one archive a brand: its index, and a term bank and a meta bank for every 500 parts, as JSON.

    Definitions are a list of texts, a list with an object, or an object; readings are given for three of four; every seventh
    row is too short, every thirteenth blank. Ranks are numbers, texts or objects, and some are not usable.
    """
    part = table(spark, sf_dir, "part")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind, size, key = F.col("p_partkey") % 3, F.col("p_size").cast("string"), F.col("p_partkey")
    definitions = F.when(kind == 0, F.format_string('["%s","%s"]', "p_type", "p_brand")).when(kind == 1, F.format_string('[{"type":"text","text":"%s"},"%s"]', "p_type", "p_brand"))
    definitions = definitions.otherwise(F.format_string('{"type":"structured-content","content":[{"tag":"li","content":"%s"},{"tag":"li","content":["%s"]}]}', "p_type", "p_brand"))
    name = F.when(key % 13 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    reading = F.when((key % 4 == 0) | (key % 13 == 0), F.lit("")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    row = F.concat(F.lit("["), text(name), F.lit(","), text(reading), F.lit(',["n","v"],"",1'))
    term = F.when(key % 7 == 0, F.concat(row, F.lit("]"))).otherwise(F.concat(row, F.lit(","), definitions, F.lit(","), key.cast("string"), F.lit(',"P"]')))
    rank = F.when(kind == 0, size).when(kind == 1, F.format_string('"#%s"', size)).otherwise(F.format_string('{"frequency":{"value":%s}}', size))
    freq = F.concat(F.lit("["), text(F.col("p_name")), F.lit(',"freq",'), F.when(key % 5 == 0, "[]").otherwise(rank), F.lit("]"))
    pitch = F.concat(F.lit("["), text(F.col("p_name")), F.format_string(',"pitch",{"pitches":[{"position":%s},{"position":0}]}]', (F.col("p_size") % 5).cast("string")))
    bank = F.floor((key - 1) / 500)
    whole = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("x")))), lambda e: e["x"]), ","), F.lit("]"))
    banks = part.groupBy("p_brand", bank.alias("bank")).agg(whole(term).alias("terms"), whole(F.concat(freq, F.lit(","), pitch)).alias("meta"))
    path = F.concat("p_brand", F.lit(".zip"))
    members = [
        part.select("p_brand").distinct().select(path.alias("path"), F.lit(0).alias("ord"), F.lit("index.json").alias("member"), F.format_string('{"title":"%s","format":3,"revision":"r1"}', "p_brand").alias("text")),
        banks.select(path, (F.col("bank") * 2 + 1).cast("int"), F.format_string("term_bank_%s.json", F.col("bank").cast("string")), "terms"),
        banks.select(path, (F.col("bank") * 2 + 2).cast("int"), F.format_string("term_meta_bank_%s.json", F.col("bank").cast("string")), "meta"),
    ]
    return members[0].union(members[1]).union(members[2]).withColumn("kind", member_kind(F.col("member")))


ARCHIVE_SQL = """usable as (
  select *, p_partkey % 3 as kind from part where p_partkey % 7 <> 0 and p_partkey % 13 <> 0
), ranks as (
  select p_name as k, arg_max(p_size, struct_pack(b := p_brand, p := p_partkey)) filter (where p_partkey % 5 <> 0) as rank,
    arg_max(concat(p_size % 5, ',0'), struct_pack(b := p_brand, p := p_partkey)) as pitch
  from part group by p_name
), imported as (
  select row_number() over (order by p_brand, p_partkey) as id, p_name as expression, case when p_partkey % 4 = 0 then p_name else split_part(p_name, ' ', 2) end as reading,
    case kind when 2 then concat(p_type, '; ', p_brand) else concat(p_type, '|', p_brand) end as definitions, coalesce(rank, 0)::int as frequency, pitch as pitch_accent,
    'n, v, P' as parts_of_speech, p_brand as dictionary_name, p_partkey::int as sequence_number
  from usable join ranks on k = p_name)"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", k).alias("query"), F.col("ts").alias("moment"))


SEARCH_LOG_SQL = """search_log as (select event_id, concat(event_type, '-', regexp_extract(props, '"k": *(\\d+)', 1)) as query, ts as moment from events)"""


def export_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("expression"), F.col("o_orderstatus").alias("reading"), F.col("o_orderpriority").alias("deck_name"), F.col("o_orderkey").alias("note_id"), F.col("o_orderdate").alias("moment"))


EXPORT_LOG_SQL = """export_log as (select o_custkey::varchar as expression, o_orderstatus as reading, o_orderpriority as deck_name, o_orderkey as note_id, o_orderdate as moment from orders)"""


def keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dictionary for each brand."""
    return entries(spark, sf_dir).groupBy(F.col("dictionary_name").alias("name")).agg(F.count(F.lit(1)).alias("entry_count"), F.min("id").alias("id")).withColumn("priority", (F.col("id") % 3).cast("int"))


def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and accents of all parts; those of odd size stand under names that no entry has."""
    return table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?"))).alias("expression"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("pos"), F.concat_ws(",", F.col("p_size") % 4, F.lit(0)).alias("pitch"))
