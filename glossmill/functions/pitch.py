"""Morae and pitch accents of readings, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import nonblank

# Characters that join the mora before them, names of the patterns, and the look of a mora.
JOINED = "ゃゅょぁぃぅぇぉャュョァィゥェォっッー"
FLAT, HEAD, TAIL, MIDDLE = "平板", "頭高", "尾高", "中高"
LABEL_STYLE = "font-size:12px;color:#999;"
HIGH_STYLE, LOW_STYLE = "border-top:2px solid #ff8a65;padding-top:2px;", "padding-top:4px;"
FALL_STYLE, RISE_STYLE = "border-right:2px solid #ff8a65;", "border-right:2px solid #666;"


def morae(reading: Column) -> Column:
    return F.regexp_extract_all(reading, F.lit(f"(?s).[{JOINED}]*"), 0)


def is_high(i: Column, drop: Column) -> Column:
    """Pitch of mora i, from 0: flat words stay high after the first, others fall after mora `drop`."""
    return F.when(drop == 0, i > 0).when(drop == 1, i == 0).otherwise((i > 0) & (i < drop))


def pitch_pattern(count: Column, drop: Column) -> Column:
    """Whether each of `count` morae is high; a lone mora is high unless the word is flat."""
    several = F.transform(F.sequence(F.lit(0), count - 1), lambda i: is_high(i, drop))
    return F.when(count <= 0, F.array().cast("array<boolean>")).when(count == 1, F.array(drop != 0)).otherwise(several)


def pitch_label(count: Column, drop: Column) -> Column:
    return F.when(drop == 0, FLAT).when(drop == 1, HEAD).when(drop == count, TAIL).otherwise(MIDDLE)


def positions(listed: Column) -> Column:
    """Whole numbers of a comma-separated list; what is none is skipped."""
    numbers = F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(numbers, lambda x: x.isNotNull())


def pitch_html(reading: Column, listed: Column) -> Column:
    """Every accent of a reading: its number and name, and its morae with lines where the pitch is high or changes."""

    def mora(count: Column, drop: Column, text: Column, i: Column) -> Column:
        high, following = F.when(count == 1, drop != 0).otherwise(is_high(i, drop)), is_high(i + 1, drop)
        edge = F.when((i < count - 1) & (high != following), F.when(high, FALL_STYLE).otherwise(RISE_STYLE)).otherwise("")
        return F.concat(F.lit('<span style="'), F.when(high, HIGH_STYLE).otherwise(LOW_STYLE), edge, F.lit(' display:inline-block;">'), text, F.lit("</span>"))

    def accent(units: Column, drop: Column) -> Column:
        count = F.size(units)
        head = F.concat(F.lit(f'<span style="{LABEL_STYLE}">['), drop.cast("string"), F.lit("] "), pitch_label(count, drop), F.lit("</span> "))
        return F.concat(head, F.array_join(F.transform(units, lambda text, i: mora(count, drop, text, i)), ""))

    def shown(units: Column) -> Column:
        found = positions(listed)
        return F.when(nonblank(listed) & (F.size(found) > 0) & (F.size(units) > 0), F.array_join(F.transform(found, lambda drop: accent(units, drop)), "&nbsp;&nbsp;")).otherwise("")

    # the morae are the one element of an array, so that they are found once a reading and not once a mora
    return F.get(F.transform(F.array(morae(reading)), shown), 0)
