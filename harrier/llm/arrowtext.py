"""Small vectorised helpers over Arrow text columns, used inside ``mapInArrow`` tasks.

Everything here works on blocks of about one megabyte of UTF-8 bytes, so a task's memory does not depend on
the number or the length of its documents beyond the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str, *more: Column) -> tuple[DataFrame, int]:
    """The kept columns, the text if it isn't one of them, and more columns; and the place of the text."""
    if text in keep:
        return docs.select(*keep, *more), keep.index(text)
    return docs.select(*keep, F.col(text).alias("__text"), *more), len(keep)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def byte_table(chars: bytes) -> np.ndarray:
    """A 256-entry membership table of byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space, and of words made of digits, letters and non-ASCII characters.
NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
ALNUM = byte_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
_WEIGHT = seeded(11, 256)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = 0xD6E8FEB86659FD93
        for key, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums S of values[i] * base**i; ``span_hash`` reads the hash of any span from them."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the len + 1 offsets of a string or binary array; nulls count as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8), at


def row_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least and ``BLOCK_ROWS`` at most."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), row + BLOCK_ROWS, n)
        yield row, stop
        row = stop


class Words:
    """The words of a block of documents: hashes, the byte span of each, and where each document's words begin."""

    __slots__ = ("bytes", "hashes", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        """data: the block's bytes; offsets: of its documents, from 0; table: bytes of words, after lower-casing A-Z."""
        low = LOWER[data]
        inside = table[low]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            begins = offsets[:-1][offsets[:-1] < len(inside)]
            before[begins] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.bytes = low
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.hashes = span_hash(prefix_hash(_WEIGHT[low]), self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)


def word_blocks(column: pa.Array, table: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for each block of a text column."""
    data, offsets = text_buffers(column)
    for row, stop in row_blocks(offsets, size):
        at = offsets[row : stop + 1]
        yield row, stop, Words(data[at[0] : at[-1]], at - at[0], table)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` word hashes (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    keys = seeded(29, width) | np.uint64(1)
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += mix64(hashes[i : i + n] + keys[i]) * keys[i]
    return mix64(total)


def pack_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose i-th row holds the next lengths[i] of the values."""
    at = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))
