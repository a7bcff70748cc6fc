"""Pre-tokens of byte-level vocabularies, cut by array operations over many texts at once.

The cut is that of the published pattern of these vocabularies: a contraction, or a run of letters, of numbers or of
other signs, each with one blank before it, or white space.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from tokenizers import pre_tokenizers

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
BLANK, QUOTE = 32, 39
#: The contractions of the pattern, without their quote.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")


BLOCK = 1 << 12
KINDS = np.full(0x110000, SPACE, np.uint8)
KNOWN = np.zeros(0x110000 // BLOCK, bool)


@functools.cache
def _cut():
    return pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str


def kinds(codes: np.ndarray) -> np.ndarray:
    """The kind of each code point, as the tokenizers library's edition of Unicode has it.

    A code point is of the kind of the sign that it joins in one pre-token. Blocks of code points are asked for once.
    """
    seen = np.zeros(len(KNOWN), bool)
    seen[codes // np.uint32(BLOCK)] = True
    for block in np.flatnonzero(seen).tolist():
        if not KNOWN[block]:
            points = [c for c in range(block * BLOCK, (block + 1) * BLOCK) if not 0xD800 <= c < 0xE000 and c != QUOTE]
            for kind, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                text = "".join(f"\n{sign}{chr(c)}" for c in points)
                joined = [a for _, (a, b) in _cut()(text) if b - a == 2 and text[a] == sign]
                KINDS[np.array(points, np.int64)[np.array(joined, np.int64) // 3]] = kind
            if block == QUOTE // BLOCK:
                KINDS[QUOTE] = OTHER
            KNOWN[block] = True
    return KINDS[codes]


def pretokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The UTF-8 bytes of all pre-tokens in order, and how many each text has."""
    joined = "".join(texts)
    n = len(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(codes)
    first = np.zeros(n + 1, bool)
    first[np.r_[0, np.cumsum(lengths)]] = True
    starts_at = first[:n].copy()
    runs = np.flatnonzero((kind[1:] != kind[:-1]) & ~first[1:n]) + 1
    after_space = (kind[runs] != SPACE) & (kind[runs - 1] == SPACE)
    starts_at[runs] = True
    starts_at[runs[after_space] - 1] = True
    starts_at[runs[after_space & (codes[runs - 1] == BLANK)]] = False
    quotes = np.flatnonzero((codes == QUOTE) & starts_at)
    for p in quotes.tolist():
        if p + 1 >= n or first[p + 1]:
            continue
        if joined[p + 1] in SHORT_ENDINGS:
            size = 2
        elif p + 2 < n and not first[p + 2] and joined[p + 1 : p + 3] in LONG_ENDINGS:
            size = 3
        else:
            continue
        starts_at[p + 1] = False
        if p + size < n and kind[p + size] == LETTER:
            starts_at[p + size] = True
    starts = np.flatnonzero(starts_at)
    counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(lengths)]))
    data = joined.encode("utf-8", "surrogatepass")
    edges = np.r_[starts, n]
    if len(data) > n:  # from code points to bytes
        leads = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)  # all bytes but those that continue a code point
        edges = np.r_[leads[starts], len(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]), counts
