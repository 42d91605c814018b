"""Which texts contain which others, by an equality join on parts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the parts by which texts meet; a shorter needle is looked for as a whole.
GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of `size` characters of a text; none where it is shorter. The one of no characters is the empty text."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda k: F.substring(text, k, size))))


def containing(haystacks: DataFrame, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """(haystack, needle): distinct texts of haystacks(text) and needles(text) where the first contains the second.

    A needle stands under the one of its grams that the fewest haystacks have, a haystack under all of its own, and what meets
    is checked as a whole. So needles that share a common part with everything still meet few haystacks. Needles that are
    shorter than a gram stand under themselves, and haystacks then under their grams of that length too; the empty needle is
    in every haystack. Nulls are in nothing and contain nothing; empty tables give no rows.
    """
    whole = haystacks.select(F.col("text").alias("haystack")).filter("haystack is not null").distinct()
    sought = needles.select(F.col("text").alias("needle")).filter("needle is not null").distinct()
    lengths = [r[0] for r in sought.select(F.least(F.length("needle"), F.lit(gram)).alias("n")).distinct().collect()]  # gram + 1 numbers at most
    if not lengths:
        return whole.select("haystack", F.col("haystack").alias("needle")).limit(0)
    each = F.flatten(F.array_compact(F.array(*[_grams(F.col("haystack"), n) if n else F.array(F.lit("")) for n in sorted(lengths)])))
    held = whole.select("haystack", F.explode(each).alias("gram"))
    frequency = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("needle") < gram, F.array("needle")).otherwise(_grams(F.col("needle"), gram))
    parts = sought.select("needle", F.explode(own).alias("gram"))
    keyed = parts.join(frequency, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return held.join(keyed, "gram").filter(F.col("haystack").contains(F.col("needle"))).select("haystack", "needle")


def touching(texts: DataFrame, others: DataFrame, gram: int = GRAM) -> DataFrame:
    """(text): distinct texts of texts(text) that contain one of others(text) or are contained in one."""
    inside = containing(others, texts, gram).select(F.col("needle").alias("text"))
    return containing(texts, others, gram).select(F.col("haystack").alias("text")).union(inside).distinct()
