import pytest
from pyspark.sql import functions as F

from glossmill.functions import pitch, structured, text

HTML = (
    '<span style="font-size:12px;color:#999;">[2] 中高</span> <span style="padding-top:4px;border-right:2px solid #666; display:inline-block;">た</span>'
    '<span style="border-top:2px solid #ff8a65;padding-top:2px;border-right:2px solid #ff8a65; display:inline-block;">べ</span>'
    '<span style="padding-top:4px; display:inline-block;">る</span>'
)


def one(spark, function, *values):
    names = [f"c{k}" for k in range(len(values))]
    row = spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(values, names, strict=True)]).select(function(*map(F.col, names)))
    return row.first()[0]


@pytest.mark.parametrize(("function", "value", "expected"), [
    (pitch.morae, "たべる", ["た", "べ", "る"]),
    (pitch.morae, "きゃっとー", ["きゃっ", "とー"]),
    (pitch.morae, "", []),
    (pitch.positions, "1, 2,x", [1, 2]),
    (text.frequency_label, 0, ""),
    (text.frequency_label, 1000, "★★★ Top 1K"),
    (text.frequency_label, 50001, "#50001"),
    (text.format_number, 999, "999"),
    (text.format_number, 1250, "1.3K"),
    (text.format_number, 999950, "1000.0K"),
    (text.format_number, 1500000, "1.5M"),
    (text.format_bytes, 1023, "1023 B"),
    (text.format_bytes, 1024, "1 KB"),
    (text.format_bytes, 1572864, "1.5 MB"),
    (text.escape_html, "a<b>&\"'", "a&lt;b&gt;&amp;&quot;&#x27;"),
    (text.deck_name, " ", "Mining Deck"),
    (text.deck_name, "A::B<x>", "A::Bx"),
    (text.deck_name, "<>", "Mining Deck"),
    (text.escape_like, " 5%_\\ ", "5\\%\\_\\\\"),
    (text.file_name, "../a/b", "ab"),
    (text.nonblank, "　 ", False),
    (text.contains_kanji, "食べる", True),
    (text.contains_kanji, "々た", False),
    (text.shortened, "x" * 121, "x" * 117 + "..."),
])
def test_golden(spark, function, value, expected):
    assert one(spark, function, value) == expected


@pytest.mark.parametrize(("count", "drop", "expected"), [(3, 0, "LHH"), (3, 1, "HLL"), (3, 2, "LHL"), (3, 3, "LHH"), (1, 0, "L"), (1, 1, "H"), (0, 4, "")])
def test_pitch_pattern(spark, count, drop, expected):
    assert "".join("LH"[h] for h in one(spark, pitch.pitch_pattern, count, drop)) == expected


def test_pitch_html(spark):
    assert one(spark, pitch.pitch_html, "たべる", "2") == HTML
    assert one(spark, pitch.pitch_html, "たべる", "2,x,2") == HTML + "&nbsp;&nbsp;" + HTML
    assert one(spark, pitch.pitch_html, "たべる", "") == one(spark, pitch.pitch_html, "", "1") == ""


@pytest.mark.parametrize(("value", "expected"), [
    ("x", ["x"]), (["a", " ", {"type": "text", "text": "b"}], ["a", "b"]), ([["a", {"text": "b"}, ["dropped"]]], ["a; b"]),
    ({"glossary": ["a", "b"]}, ["a, b"]), ({"type": "structured-content"}, []), ({"type": ["bad"]}, []), (None, ["null"]), (3.5, ["3.5"]), (True, ["true"]),
])
def test_definitions(value, expected):
    assert structured.definitions_of(value) == expected


def test_deep_content():
    deep = "end"
    for _ in range(200):
        deep = {"tag": "div", "content": [deep]}
    assert structured.content_text(deep) == "end"


@pytest.mark.parametrize(("value", "expected"), [("12/34", 1234), (3.5, 35), ({"value": [1]}, 0), ({"frequency": {"displayValue": "７位"}}, 7), ({"frequency": "x", "displayValue": "4"}, 4), (10**12, 0)])
def test_frequency(value, expected):
    assert structured.frequency_of(value) == expected


def test_pitch_html_finds_the_morae_once_a_reading(spark):
    df = spark.createDataFrame([("きゃく", "0, x,2"), ("か", "1"), ("かな", None), (None, "1"), ("", "0")], "r string, a string").select(pitch.pitch_html(F.col("r"), F.col("a")).alias("html"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    shown = [r.html for r in df.collect()]
    assert shown[2:] == ["", "", ""] and shown[0].count("[0] 平板") == shown[0].count("[2] 尾高") == 1 and shown[0].count(">きゃ<") == 2
    assert pitch.HIGH_STYLE in shown[1] and pitch.FALL_STYLE not in shown[1]
