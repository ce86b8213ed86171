"""Byte-level pre-tokenisation over whole Arrow blocks.

The split rule is the one of the public byte-level BPE tokenizers:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Instead of running a regular expression over each text, code points are mapped to
classes once and the borders between pre-tokens follow from class changes, for a
block of texts at a time.  The pre-tokens cover the texts without gaps, so the
borders are at the same time the offsets of an Arrow binary array over the text
bytes, and its dictionary holds the distinct pre-tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The contraction suffixes of the split rule.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, everything))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def borders(offsets: np.ndarray, body: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the pre-tokens, number of pre-tokens before each text and in all).

    offsets, body: as from utf8_buffers.  special: this string is one pre-token
    wherever it occurs, and ends the text before it as far as the rule is concerned.
    """
    if not len(body):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    raw = body.tobytes()
    if raw.isascii():
        points, at_byte = body, None
    else:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at_byte = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
    n = len(points)
    to_point = (lambda b: b) if at_byte is None else (lambda b: np.searchsorted(at_byte, b))
    fresh = np.zeros(n + 1, bool)  # a text, or a part beside a special string, starts here
    fresh[to_point(offsets)] = True
    inside = []
    if special and special in raw:
        rows, found, i = offsets.tolist(), [], raw.find(special)
        while i >= 0:
            j = int(np.searchsorted(offsets, i, side="right"))
            if j < len(rows) and i + len(special) <= rows[j]:
                found.append(i)
                i = raw.find(special, i + len(special))
            else:
                i = raw.find(special, i + 1)
        for i in found:
            a, b = int(to_point(np.int64(i))), int(to_point(np.int64(i + len(special))))
            fresh[a] = fresh[b] = True
            inside.append((a, b))
    kind = classes()[points]
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[n] = True
    space = kind == SPACE
    blank = points == 32
    # The last blank of a run of white space goes with what follows in the same text.
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~fresh[1:n]
    last = space & follows
    start[:-1] |= last
    joined = np.flatnonzero(last & blank) + 1
    start[joined] = False
    # A lone apostrophe that no blank precedes, then the suffix of a contraction.
    quote = np.flatnonzero((points == 39) & start[:n])
    if len(quote):
        quote = quote[quote + 1 < n]
        quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        has_two = (quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)]
        length = np.zeros(len(quote), np.int64)
        for suffix in CONTRACTIONS:
            fits = one == ord(suffix[0])
            if len(suffix) == 2:
                fits &= has_two & (two == ord(suffix[1]))
            length = np.where((length == 0) & fits, len(suffix), length)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        start[quote + 1 + length] = True
    for a, b in inside:
        start[a + 1 : b] = False
    cuts = np.flatnonzero(start)
    before = np.searchsorted(cuts, to_point(offsets))
    return (cuts if at_byte is None else at_byte[cuts]).astype(np.int64), before.astype(np.int64)


def safe_cuts(body: np.ndarray, limit: int) -> list[int]:
    """Byte offsets, from 0 to the end, that cut a long text into pieces of about ``limit`` bytes.

    A cut lies before a blank or line feed between two ASCII letters or digits: the
    pre-token before it ends there and the next one begins there, whatever else the text
    holds, and no special string has such a place.  Where there is none for long, a piece
    is longer.
    """
    out, n = [0], len(body)
    while n - out[-1] > limit:
        at = out[-1] + limit
        while at < n:
            end = min(at + limit, n - 1)
            here = np.isin(body[at:end], (32, 10)) & _PLAIN[body[at - 1 : end - 1]] & _PLAIN[body[at + 1 : end + 1]]
            hits = np.flatnonzero(here)
            if len(hits):
                at += int(hits[0])
                break
            at = max(end, at + 1)
        if at >= n - 1:
            break
        out.append(at)
    return [*out, n]


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def distinct(cuts: np.ndarray, body: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct pre-tokens, index into them of each pre-token)."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    array = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
    coded = array.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
