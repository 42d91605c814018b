"""The elements of JSON arrays of any size, cut from their bytes as these arrive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_QUOTE, _ESCAPE, _COMMA, _BLANKS = ord('"'), ord("\\"), ord(","), b" \t\r\n"
_OPEN, _CLOSE = b"[{", b"]}"
_KIND = np.zeros(256, np.int8)
for _bytes, _kind in ((b'"', 1), (b"\\", 2), (b",", 3), (_OPEN, 4), (_CLOSE, 5)):
    _KIND[list(_bytes)] = _kind


class NotAnArray(ValueError):
    """The bytes are no JSON array, or end before it does."""


def elements(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of each element of a JSON array, blanks around them taken off.

    Only strings and brackets are followed, so that the array is cut right if it is right; whether an element is JSON is for
    its reader to see. What is held is one element and one chunk. Raises NotAnArray where no array begins, where it does not
    end, and where something follows it; elements before that have been given by then.
    """
    depth, inside, odd, began, over, commas = 0, False, False, False, False, 0
    held: list[bytes] = []
    for chunk in chunks:
        if not chunk:
            continue
        at = 0
        if not began:
            at = len(chunk) - len(chunk.lstrip(_BLANKS))
            if at == len(chunk):
                continue
            if chunk[at] != _OPEN[0]:
                raise NotAnArray("no array begins")
            began, depth, at = True, 1, at + 1
        if over:
            if chunk.strip(_BLANKS):
                raise NotAnArray("something follows the array")
            continue
        data = np.frombuffer(chunk, np.uint8)
        place = np.flatnonzero(_KIND[data[at:]]) + at
        kind = _KIND[data[place]]
        quote = kind == 1
        if odd or (kind == 2).any():
            # how many escapes stand right before each place, those of the chunk before included
            escape = place[kind == 2]
            starts = np.flatnonzero(np.append(True, np.diff(escape) > 1)) if len(escape) else np.zeros(0, np.int64)
            run = np.arange(len(escape)) - np.repeat(starts, np.diff(np.append(starts, len(escape)))) + 1
            if odd and len(escape) and escape[0] == at:
                first = starts[1] if len(starts) > 1 else len(escape)
                run[:first] += 1
            k = np.searchsorted(escape, place) - 1
            near = (k >= 0) & (escape[np.maximum(k, 0)] == place - 1) if len(escape) else np.zeros(len(place), bool)
            odds = near & (run[np.maximum(k, 0)] % 2 == 1) if len(escape) else near
            if odd and len(place) and place[0] == at:
                odds[0] = kind[0] != 2
            quote &= ~odds
            odd = bool(run[-1] % 2) if len(escape) and escape[-1] == len(chunk) - 1 else False
        within = (np.cumsum(quote) + inside) % 2 == 1
        inside = bool(within[-1]) if len(within) else inside
        outside = ~within & ~quote
        levels = depth + np.cumsum(np.where(outside & (kind == 4), 1, 0) - np.where(outside & (kind == 5), 1, 0))
        depth = int(levels[-1]) if len(levels) else depth
        for p in place[outside & ((kind == 3) & (levels == 1) | (kind == 5) & (levels <= 0))].tolist():
            held.append(chunk[at:p])
            found = b"".join(held).strip(_BLANKS)
            held, at = [], p + 1
            if chunk[p] == _COMMA:
                commas += 1
                yield found
                continue
            if chunk[p] != _CLOSE[0]:
                raise NotAnArray("the array ends with another bracket")
            over = True
            if found or commas:
                yield found
            if chunk[at:].strip(_BLANKS):
                raise NotAnArray("something follows the array")
            break
        if not over:
            held.append(chunk[at:])
    if not over:
        raise NotAnArray("the array does not end" if began else "no array begins")
