"""Byte-level pre-tokenisation over whole Arrow batches.

The pattern of the public byte-level tokenizers (contractions, optional space
plus letters, digits or other signs, and white space) is regular, so the starts
of all pre-tokens follow from the classes of neighbouring characters. They are
found with array operations over a batch at once, and since pre-tokens tile the
text, they are slices of the batch's own buffer and never copied.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)

# The contractions that form a pre-token of their own after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start()] : points[m.end() - 1] + 1] = kind
    # A run may span the gap of the surrogates, which no text holds.
    table[0xD800:0xE000] = OTHER
    return table


def starts_of(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a pre-token starts; ``doc_start`` marks the first of each text."""
    n = len(points)
    kind = classes()[points]
    run = doc_start.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()

    # White space before a text's next word: its last sign stands alone, or leads that word if it is a blank.
    follow = np.flatnonzero(run & ~doc_start & (kind != SPACE))
    follow = follow[kind[follow - 1] == SPACE]
    start[follow - 1] = True
    start[follow[points[follow - 1] == 0x20]] = False

    # An apostrophe that starts a pre-token takes a contraction's letters with it.
    quote = np.flatnonzero(start & (points == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~doc_start[quote + 1]]
    for letters in CONTRACTIONS:
        k = len(letters)
        at = quote[quote + k < n]
        for j, c in enumerate(letters, 1):
            at = at[(points[at + j] == ord(c)) & ~doc_start[at + j]]
        start[at + 1] = False
        rest = at + 1 + k
        rest = rest[rest < n]
        start[rest[(kind[rest] == LETTER) & ~doc_start[rest]]] = True
    return start


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of a string array as one binary array, and each text's offsets into it.

    Null and empty texts have no pre-tokens.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else b""
    offsets = offsets - offsets[0]
    if not offsets[-1]:
        return pa.array([], pa.large_binary()), np.zeros(n + 1, np.int64)
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    firsts = np.searchsorted(at, offsets)
    doc_start = np.zeros(len(points), bool)
    doc_start[firsts[:-1][firsts[:-1] < len(points)]] = True
    start = np.flatnonzero(starts_of(points, doc_start))
    bounds = np.append(at[start], at[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    return words, np.searchsorted(start, firsts)
