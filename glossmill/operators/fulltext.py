"""Full-text search by a token table: phrases within one column, exact or with the last token as a prefix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import ascii_lower

#: A token is a run of ASCII letters and digits and of all characters from U+0080 on.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def match_query(query: str) -> str:
    """The query as a quoted phrase; quotes in it are doubled. A blank query gives nothing."""
    query = query.strip()
    return '"' + query.replace('"', '""') + '"*' if query else ""


def phrases(query: str) -> list[list[str]]:
    """Phrases that a quoted query stands for: the parts between its quotes, as folded tokens."""
    folded = "".join(c.lower() if c.isascii() else c for c in query)
    found = [_TOKEN.findall(part) for part in folded.split('"')]
    return [p for p in found if p]


def token_table(rows: DataFrame, id_: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, col, pos, token): the index. Write it once, partitioned or sorted by token, and searches read few of its rows."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns])
    texts = rows.select(F.col(id_).alias("id"), F.explode(each).alias("x"))
    return texts.select("id", "x.col", F.posexplode(F.regexp_extract_all(ascii_lower(F.col("x.text")), F.lit(TOKEN), 0)).alias("pos", "token"))


def match(tokens: DataFrame, query: str, prefix_last: bool = False) -> DataFrame:
    """(id): rows in which every phrase of the query stands in one column.

    Each phrase token keeps the index rows that hold it, shifted to where the phrase would begin; a phrase is where all its
    tokens meet. The filter on tokens reaches the scan of a stored index.
    """
    found = None
    for phrase in phrases(query):
        exact = phrase[:-1] if prefix_last else phrase
        wanted = F.col("token").isin(sorted(set(exact)))
        if prefix_last:
            wanted = wanted | F.col("token").startswith(phrase[-1])
        hit = None
        for k, token in enumerate(phrase):
            same = F.col("token").startswith(token) if prefix_last and k == len(phrase) - 1 else F.col("token") == token
            here = F.when(same, F.lit(k))
            hit = F.array(here) if hit is None else F.array_append(hit, here)
        shifted = tokens.filter(wanted).select("id", "col", "pos", F.explode(F.array_compact(hit)).alias("k")).select("id", "col", (F.col("pos") - F.col("k")).alias("start"), "k")
        ids = shifted.groupBy("id", "col", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(phrase)).select("id").distinct()
        found = ids if found is None else found.join(ids, "id", "left_semi")
    return tokens.select("id").limit(0) if found is None else found


def search(entries: DataFrame, tokens: DataFrame, query: str, keys: list, limit: int = 50, prefix_last: bool = False) -> DataFrame:
    return entries.join(match(tokens, query, prefix_last), "id", "left_semi").orderBy(*keys).limit(limit)
