"""Ranked lookups of entries: exact, prefix and combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions.text import ascii_lower, nonblank

#: An escape character that no query has: in the patterns, % and _ are wildcards and nothing escapes them.
NO_ESCAPE = "\x01"
COMBINED_LIMIT, PREFIX_LIMIT = 50, 30
#: Characters of queries that go whole to every task; more are met by a shuffle of both sides.
MOST_ASKED = 1 << 21


def rank_keys() -> list[Column]:
    """Ranked entries first, the most frequent of them first."""
    return [F.when(F.col("frequency") > 0, 0).otherwise(1).asc(), F.col("frequency").asc()]


def by_expression(entries: DataFrame, expression: str) -> DataFrame:
    return entries.filter(F.col("expression") == expression).orderBy(*rank_keys(), "id")


def by_reading(entries: DataFrame, reading: str) -> DataFrame:
    return entries.filter(F.col("reading") == reading).orderBy(*rank_keys(), "id")


def by_id(entries: DataFrame, id_: int) -> DataFrame:
    return entries.filter(F.col("id") == id_)


def begins(column: Column, prefix: str, wildcards: bool = True) -> Column:
    """Whether the column begins with the prefix, ASCII letters in either case; % and _ are wildcards unless told otherwise."""
    folded = ascii_lower(F.lit(prefix))
    if wildcards and any(c in prefix for c in "%_"):
        return F.like(ascii_lower(column), F.concat(folded, F.lit("%")), F.lit(NO_ESCAPE))
    return ascii_lower(column).startswith(folded)


def prefix(entries: DataFrame, text: str, limit: int = PREFIX_LIMIT, wildcards: bool = True) -> DataFrame:
    found = entries.filter(begins(F.col("expression"), text, wildcards) | begins(F.col("reading"), text, wildcards))
    return found.orderBy(*rank_keys(), F.length("expression"), "id").limit(limit)


def combined(entries: DataFrame, query: str | None, limit: int = COMBINED_LIMIT, wildcards: bool = True) -> DataFrame:
    """Entries whose expression or reading is the query or begins with it: exact expressions, exact readings, then prefixes.

    The query is trimmed; a blank one finds nothing. Adds rnk, the place in the result, from 1.
    """
    query = (query or "").strip()
    if not query:
        return entries.limit(0).withColumn("rnk", F.lit(0))
    expression, reading = F.col("expression"), F.col("reading")
    hit = (expression == query) | (reading == query) | begins(expression, query, wildcards) | begins(reading, query, wildcards)
    tier = F.when(expression == query, 0).when(reading == query, 1).otherwise(2)
    return ranked(entries.filter(hit), [tier, *rank_keys(), F.length("expression"), F.col("id")], limit)


def ranked(rows: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows by the keys, with their place rnk. The window sees no more than these rows."""
    return rows.orderBy(*keys).limit(limit).withColumn("rnk", F.row_number().over(Window.orderBy(*keys)))


def combined_many(entries: DataFrame, queries: DataFrame, limit: int = COMBINED_LIMIT, most: int = MOST_ASKED) -> DataFrame:
    """combined() without wildcards for each distinct query of queries(query), with the query beside each row.

    Texts meet the queries by an equality join: a query stands under its folded self, a text under its beginnings of just the lengths
    that queries have. A query's rows are cut to `limit` before they move. Blank and null queries find nothing. Which side
    goes to every task is told here, by what was counted: Spark guesses the beginnings by the size of the entries' file, and
    would gather them in the driver.
    """
    asked = queries.select(F.trim("query").alias("query")).filter(nonblank(F.col("query"))).distinct()
    counted = asked.groupBy(F.length("query").alias("n")).agg(F.count(F.lit(1)).alias("of")).collect()  # as many as the longest query has characters, at most
    lengths, size = sorted(r["n"] for r in counted), sum(r["n"] * r["of"] for r in counted)
    texts = F.array_distinct(F.array_compact(F.array(ascii_lower(F.col("expression")), ascii_lower(F.col("reading")))))
    cut = lambda t: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(t)), lambda n: F.substring(t, F.lit(1), n))
    begun = entries.withColumn("_begins", F.explode(F.array_distinct(F.flatten(F.transform(texts, cut)))))
    keyed = asked.select("query", ascii_lower(F.col("query")).alias("_folded")).hint("broadcast" if size <= most else "merge")
    hit = begun.join(keyed, F.col("_begins") == F.col("_folded")).drop("_begins", "_folded")
    tier = F.when(F.col("expression") == F.col("query"), 0).when(F.col("reading") == F.col("query"), 1).otherwise(2)
    order = Window.partitionBy("query").orderBy(tier, *rank_keys(), F.length("expression"), "id")
    return hit.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= limit)
