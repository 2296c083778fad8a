"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of one pre-token are driven by a queue with one bucket for each merge rank. A bucket holds positions
of the pre-token's linked list of parts; two levels of bit words say which buckets hold anything, so that find-first-set
on each level gives the lowest rank in constant time. Positions whose pair has changed since they
were queued are skipped when they come up. A pre-token of n bytes takes O(n log n) time whatever its length.

Nulls are encoded as empty texts; empty texts give no ids. Repeated rows are encoded each on its own. Only the
columns named in ``keep`` are read besides the text, so other columns and their names don't matter.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import row_blocks, text_buffers

#: Entries of each of a worker's two tables of encoded pre-tokens; when the newer one is full, it becomes the older.
CACHE_ENTRIES = 250_000
#: Longer pre-tokens aren't kept in that table.
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes texts by a rank table; one of these lives in each Python worker.

    ``buckets[r]`` is a heap of the queued positions of rank r. ``low`` holds a bit for each rank, 256 to a word,
    and the local ``top`` of ``merge`` a bit for each word of ``low``; both are all zero between two calls.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        n_ranks = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]
        self.low = [0] * ((n_ranks >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.low)))]
        self.pairs = [-1] * 65536  # the rank of two bytes, by their values
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, get = self.ranks, self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, buckets, low, bit, pairs, top = len(piece), self.buckets, self.low, self.bit, self.pairs, 0
        following = list(range(1, n + 1))  # a part begins at i and ends at following[i]
        previous = list(range(-1, n))
        pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # by the pair's first part
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    word = rank >> 8
                    low[word] |= bit[rank & 255]
                    top |= bit[word]
                bucket.append(i)  # in ascending order: a heap
        while top:
            word = (top & -top).bit_length() - 1  # find first set, on both levels
            bits = low[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket.pop()
                low[word] = bits = bits ^ first
                if not bits:
                    top ^= bit[word]
            else:
                i = heappop(bucket)
            if pair[i] != rank:
                continue  # stale: the pair has changed or gone
            middle = following[i]
            end = following[middle]
            following[i] = end
            pair[middle] = pair[i] = -1
            before = previous[i]
            if end < n:
                previous[end] = i
                rank = get(piece[i : following[end]], -1)
                if rank >= 0:
                    pair[i] = rank
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        word = rank >> 8
                        low[word] |= bit[rank & 255]
                        top |= bit[word]
            if before >= 0:
                pair[before] = rank = get(piece[before:end], -1)
                if rank >= 0:
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, before)
                    else:
                        bucket.append(before)
                        word = rank >> 8
                        low[word] |= bit[rank & 255]
                        top |= bit[word]
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def missing(self, word: str) -> bytes:
        """The ids of a pre-token that the newer table lacks; the older one keeps what was in use before."""
        ids = self.older.get(word)
        if ids is None:
            piece = word.encode("utf-8")
            merged = self.merge(piece)
            ids = struct.pack(f"<{len(merged)}I", *merged)
            if len(piece) > CACHE_BYTES:
                return ids
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([self.cache.get(word) or self.missing(word) for word in self.find(text)])


#: A Python worker serves many tasks; its encoder and the pre-tokens it has met stay with it.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _schema(docs: DataFrame, keep: tuple[str, ...], *fields: T.StructField) -> T.StructType:
    return T.StructType([docs.schema[c] for c in keep] + list(fields))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``ids``, the token ids as packed little-endian unsigned 32-bit integers.

    The rank table has a fixed size (the vocabulary), so it is sent to the tasks as a broadcast variable.
    """
    table = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((ranks_path, pattern))
        if encoder is None:
            encoder = _ENCODERS[ranks_path, pattern] = Encoder(table.value, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            _, offsets = text_buffers(column)
            for row, stop in row_blocks(offsets):
                texts = column.slice(row, stop - row).to_pylist()
                ids = pa.array([encoder.encode(t) if t else b"" for t in texts], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, stop - row) for i in range(len(keep))), ids], names=[*keep, "ids"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, _schema(docs, keep, T.StructField("ids", T.BinaryType())))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``decoded``, the bytes that the packed ids in ``ids`` stand for (null: none)."""
    table = tokens.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = table.value.__getitem__
        for batch in batches:
            column = batch.column(len(keep))
            _, offsets = text_buffers(column)
            for row, stop in row_blocks(offsets):
                packed = column.slice(row, stop - row).to_pylist()
                texts = pa.array([b"".join(map(token_of, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in packed], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, stop - row) for i in range(len(keep))), texts], names=[*keep, "decoded"])

    return tokens.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, _schema(tokens, keep, T.StructField("decoded", T.BinaryType())))
