"""Scalar functions over text columns, as built-in expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of frequency ranks, and names of categories.
FREQUENCY_LABELS = ((1000, "★★★ Top 1K"), (3000, "★★★ Top 3K"), (5000, "★★ Top 5K"), (10000, "★ Top 10K"), (20000, "Top 20K"), (50000, "Top 50K"))
CATEGORY_LABELS = {"DICTIONARY": "Słownik", "FREQUENCY": "Częstotliwość", "PITCH_ACCENT": "Pitch Accent", "KANJI": "Kanji"}
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
DEFAULT_DECK = "Mining Deck"

#: A character that is not Unicode white space.
VISIBLE = r"[^\p{Z}\t\n\x0B\f\r\x1c-\x1f]"
EDGES = r"^[\p{Z}\t\n\x0B\f\r\x1c-\x1f]+|[\p{Z}\t\n\x0B\f\r\x1c-\x1f]+$"
KANJI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def nonblank(text: Column) -> Column:
    """Whether the text has a visible character; a null text has none."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def contains_kanji(text: Column) -> Column:
    return text.rlike(KANJI)


def frequency_label(rank: Column) -> Column:
    label = F.when(rank <= 0, "")
    for most, name in FREQUENCY_LABELS:
        label = label.when(rank <= most, name)
    return label.otherwise(F.concat(F.lit("#"), rank.cast("string")))


def display_text(expression: Column, reading: Column) -> Column:
    return F.when(nonblank(expression), expression).otherwise(reading)


def shown_reading(reading: Column, primary: Column) -> Column:
    """The reading, where it says more than the primary expression; null elsewhere."""
    return F.when(nonblank(reading) & (reading != primary), reading)


def definitions_plain(definitions: Column) -> Column:
    return F.array_join(definitions, "; ")


def definitions_numbered(definitions: Column) -> Column:
    return F.array_join(F.transform(definitions, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "; ")


def shortened(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def first_definitions(definitions: Column, shown: int = 3) -> Column:
    """(shown, more): the first definitions, and how many are left out."""
    return F.struct(F.slice(definitions, 1, shown).alias("shown"), F.greatest(F.size(definitions) - shown, F.lit(0)).alias("more"))


def decode_definitions(stored: Column) -> Column:
    """The stored JSON list; a text that is not one is the only definition."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array(stored))


def decode_list(stored: Column) -> Column:
    """The stored JSON list; a text that is not one is an empty list."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))


def encode_list(values: Column) -> Column:
    """The list as it is stored; null is an empty list."""
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def escape_html(text: Column) -> Column:
    for mark, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escape_like(text: Column) -> Column:
    """Trimmed, with the wildcards of LIKE and the escape character itself escaped."""
    text = trimmed(text)
    for mark in ("\\", "%", "_"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


# Characters that a deck's name does not have.
FORBIDDEN = r"""[<>"';&|`$\\]"""


def deck_name(name: Column) -> Column:
    """A deck name without markup and shell characters, 200 characters long at most; the default where none is left."""
    clean = F.substring(F.regexp_replace(trimmed(name), FORBIDDEN, ""), 1, 200)
    return F.when(nonblank(clean), clean).otherwise(DEFAULT_DECK)


def file_name(name: Column) -> Column:
    for part in ("..", "/", "\\", "\0"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return F.substring(name, 1, 255)


def format_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1000, F.format_string("%.1fK", n / F.lit(1e3))).otherwise(n.cast("string"))


def format_bytes(n: Column) -> Column:
    mb, kb = n / F.lit(1048576.0), n / F.lit(1024.0)
    return F.when(n >= 1048576, F.format_string("%.1f MB", mb)).when(n >= 1024, F.format_string("%.0f KB", kb)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_date(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy HH:mm")


def category_label(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair]), category)


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(0.0)
