"""A small archive, written out."""

import io
import json
import zipfile

BANK = (
    ["食べる", "", "v1", "", 1, ["to eat", {"type": "text", "text": "to live on"}], 5, "P"],
    ["ねこ", "", ["n", "P"], "", 1, "cat", None, ""],
    ["short", "", "", "", 1],
    [" ", "", "", "", 1, ["blank"]],
    ["橋", "はし", "n", "", 1, [{"type": "structured-content", "content": [{"tag": "li", "content": "a"}, {"tag": "li", "content": "b"}]}], 7],
)
META = (["食べる", "freq", {"value": 7}], ["食べる", "freq", "1,234"], ["橋", "pitch", {"pitches": [{"position": 2}]}], ["ねこ", "freq", 0], ["ねこ", "other", 3])


def sample_archive() -> bytes:
    """An index, a term bank that holds unusable rows, a broken bank, and a meta bank."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("index.json", json.dumps({"title": "Sample", "format": 3, "revision": "r1"}))
        z.writestr("term_bank_1.json", json.dumps(BANK, ensure_ascii=False))
        z.writestr("term_bank_2.json", "[broken")
        z.writestr("term_meta_bank_1.json", json.dumps(META, ensure_ascii=False))
        z.writestr("kanji_bank_1.json", "[]")
    return out.getvalue()
