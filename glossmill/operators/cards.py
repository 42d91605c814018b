"""Flash cards from entries: seven texts each, ready for a delimited file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import pitch
from glossmill.functions.text import deck_name, display_text, escape_html, frequency_label, nonblank
from glossmill.operators.store import not_exported

FIELDS = ["front", "reading", "meaning", "pitch_accent", "frequency", "audio", "sentence"]
KEYS = ["expression", "reading", "deck_name"]


def cards(entries: DataFrame, *more: Column) -> DataFrame:
    """id, the fields of a card and `more` columns for each entry; markup in the entries' texts is escaped, readings in pitch spans are not."""
    said = F.when(nonblank(F.col("reading")), F.col("reading")).otherwise(F.col("expression"))
    translation = F.col("example_sentence_translation")
    small = F.when(nonblank(translation), F.concat(F.lit("<br><small>"), escape_html(translation), F.lit("</small>"))).otherwise("")
    return entries.select(
        "id",
        escape_html(display_text(F.col("expression"), F.col("reading"))).alias("front"),
        escape_html(F.col("reading")).alias("reading"),
        F.array_join(F.transform("definitions", escape_html), "<br>").alias("meaning"),
        pitch.pitch_html(said, F.col("pitch_accent")).alias("pitch_accent"),
        escape_html(frequency_label(F.col("frequency"))).alias("frequency"),
        F.col("audio_file").alias("audio"),
        F.concat(escape_html(F.col("example_sentence")), small).alias("sentence"),
        *more,
    )


def export(entries: DataFrame, log: DataFrame, deck: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cards, rows for the export log) of the entries that the deck does not have yet, or of all where forced."""
    named = entries.withColumn("deck_name", deck_name(F.lit(deck)))
    new = named if force else not_exported(named, log, KEYS)
    return cards(new), new.select(*KEYS)


def write_cards(df: DataFrame, path: str) -> None:
    df.select(*FIELDS).write.option("sep", "\t").option("quoteAll", True).csv(path)
