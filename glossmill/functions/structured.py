"""Text from the nested JSON of dictionary archives, of any shape, which column expressions cannot follow.

JSON that is nested deeper than DEEPEST levels counts as JSON that cannot be read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

DEEPEST = 800
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def _depth(text: str) -> int:
    """How deep the brackets outside of strings are nested."""
    depth = deepest = 0
    for c in _BRACKET.findall(text):
        if c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    return deepest


#: A bracket, or a whole string, in which none counts.
_BRACKET = re.compile(r'[\[\]{}]|"(?:[^"\\]|\\.)*"', re.S)


def parsed(text: str | None):
    """The value of a JSON text; None for no text, for what is not JSON, and for what is nested too deep."""
    try:
        return json.loads(text) if text is not None and _depth(text) <= DEEPEST else None
    except ValueError:
        return None


def raw(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def scalar(value) -> str:
    """A JSON scalar as it is written, strings without quotes."""
    return value if isinstance(value, str) else raw(value)


def plain(value) -> str:
    if isinstance(value, list):
        return ", ".join(plain(v) for v in value)
    return raw(value) if isinstance(value, dict) else scalar(value)


def content_text(value) -> str:
    """Text of nested content: list items are joined by "; ", other parts by ", "."""
    if isinstance(value, list):
        parts = [p for p in map(content_text, value) if p.strip()]
        items = any(isinstance(v, dict) and v.get("tag") == "li" for v in value)
        return ("; " if items else ", ").join(parts)
    if not isinstance(value, dict):
        return scalar(value)
    if "content" in value:
        return content_text(value["content"])
    return plain(value["text"]) if "text" in value else ""


def object_text(value: dict) -> str | None:
    kind = value.get("type")
    if isinstance(kind, (dict, list)) or isinstance(value.get("text"), (dict, list)) and kind != "structured-content":
        return None
    if kind == "structured-content":
        return content_text(value["content"]) if "content" in value else None
    if kind == "text" or "text" in value:
        return scalar(value["text"]) if "text" in value else None
    for part in ("content", "glossary"):
        if part in value:
            return content_text(value[part])
    return raw(value)


def definitions_of(value) -> list[str]:
    """Definitions of an entry: a text, an object, or a list of texts, objects and lists."""
    if isinstance(value, dict):
        text = object_text(value)
        return [] if text is None else [text]
    if not isinstance(value, list):
        return [scalar(value)]
    out = []
    for item in value:
        if isinstance(item, list):
            parts = [object_text(x) if isinstance(x, dict) else scalar(x) for x in item if not isinstance(x, list)]
            out.append("; ".join(p for p in parts if p is not None))
        else:
            out.append(object_text(item) if isinstance(item, dict) else scalar(item))
    return [d for d in out if d is not None and d.strip()]


def _whole(value) -> int | None:
    """A whole number of 32 bits, written as a number or as text."""
    if isinstance(value, bool) or isinstance(value, (dict, list)) or value is None:
        return None
    try:
        n = int(scalar(value))
    except ValueError:
        return None
    return n if INT_MIN <= n <= INT_MAX else None


def _digits(value) -> int | None:
    if isinstance(value, (dict, list)) or value is None:
        return None
    return _whole("".join(c for c in scalar(value) if c.isdecimal()) or "x")


def frequency_of(value) -> int:
    """Rank of a frequency payload: a number, digits in a text, or an object that holds either; 0 where there is none."""
    if not isinstance(value, (dict, list)):
        n = _whole(value)
        return n if n is not None else _digits(value) or 0
    if isinstance(value, list):
        return 0
    if isinstance(value.get("value"), (dict, list)):
        return 0
    found = _whole(value.get("value"))
    inner = value.get("frequency")
    if found is None and isinstance(inner, dict):
        found = _whole(inner.get("value"))
        found = found if found is not None else _digits(inner.get("displayValue"))
    elif found is None and inner is not None:
        found = _whole(inner)
        found = found if found is not None else _digits(inner)
    found = found if found is not None else _digits(value.get("displayValue"))
    return found or 0


def pitch_of(value) -> str:
    """Comma-separated positions of a pitch payload; empty where any accent is not an object."""
    pitches = value.get("pitches") if isinstance(value, dict) else None
    if not isinstance(pitches, list) or any(not isinstance(p, dict) or isinstance(p.get("position"), (dict, list)) for p in pitches):
        return ""
    numbers = [_whole(p.get("position")) for p in pitches]
    return ",".join(str(n) for n in numbers if n is not None)


def _column(function, kind):
    # a filter on a deterministic one would be moved below it and call it once more, in a Python worker of its own
    return F.udf(lambda text: function(parsed(text)) if text is not None else None, kind, useArrow=True).asNondeterministic()


definitions = _column(definitions_of, ArrayType(StringType()))
structured_text = _column(lambda v: object_text(v) if isinstance(v, dict) else content_text(v), StringType())
frequency = _column(frequency_of, IntegerType())
pitch = _column(pitch_of, StringType())
