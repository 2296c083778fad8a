"""Blocks of texts as codes into the block's own list of distinct words, for operators that look words up in large tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that share a list. A document is never cut, so a longer one is a block of its own.
CODED_BYTES = 16 << 20


def coded_words(low: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words as bytes, where each document's words begin).

    low: a block's bytes; inside: which of them are in words; offsets: of its documents, from 0. A word doesn't go on
    into the next document.
    """
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets)
