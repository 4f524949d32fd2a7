"""Words of many texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

BLANK, BREAK = 0x20, 0xFF  # BREAK is no byte of UTF-8
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def byte_table(blanks: Iterable[int], breaks: Iterable[int] = (), lower: bool = False) -> bytes:
    """For ``bytes.translate``: blanks, which end words, as spaces; breaks, which phrases don't cross, as ``BREAK``; A-Z as a-z with ``lower``."""
    table = bytearray(range(256))
    for b in blanks:
        table[b] = BLANK
    for b in breaks:
        table[b] = BREAK
    return bytes(table).translate(bytes.maketrans(UPPER, LOWER)) if lower else bytes(table)


def word_codes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(codes, vocabulary, texts, pieces): each word's number in the vocabulary of distinct words, and which text and piece it stands in.

    Pieces are what breaks and ends of texts part, numbered over all texts.
    """
    buf = np.frombuffer(bytes([BREAK]).join(texts).translate(table), np.uint8)
    broken = buf == BREAK
    inside = ~broken & (buf != BLANK)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    of_text = np.searchsorted(begins, starts, side="right") - 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, of_text, np.searchsorted(np.flatnonzero(broken), starts)
