"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z. A window is
``width`` consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Tasks look
up the hash of every token window of a document in the set, verify each hit word by word, and mark the words
inside. Nothing is sampled and every window length that the benchmark has is scanned.

A benchmark of at most ``SET_WINDOWS`` windows (counted once for each item) is sent to the tasks as a whole. Of a larger one they get a bitmap of the
windows' hashes, whose size is fixed (``BITMAP_BITS``); the windows that it lets through are joined with the benchmark's,
words and all. A broadcast stays within its bound whatever the benchmark's size, and documents are read in two passes
at most. An item whose text or id is null is no item; a null document has no words. Documents are treated row by row,
so repeated rows get equal results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import ALNUM, Words, pack_lists, shingle_hashes, text_buffers, with_text, word_blocks
from harrier.llm.components import checkpointed, salted

WIDTH = 13
#: Windows in a broadcast set: at about 200 bytes each, some 40 MB.
SET_WINDOWS = 200_000
#: A bitmap of 2**26 bits is 8 MB.
BITMAP_BITS = 26
_BITS = 22

SPANS = "array<struct<start: int, end: int>>"


def windows_of(words: Words, first: int, last: int, width: int) -> list[tuple[int, int, bytes]]:
    """(words, hash, text) of each window of the item whose words are first..last."""
    n = last - first
    if not n:
        return []
    size = min(n, width)
    hashes = shingle_hashes(words.hashes[first:last], size)
    text = [words.bytes[s:e].tobytes() for s, e in zip(words.starts[first:last], words.ends[first:last], strict=True)]
    return [(size, int(h), b" ".join(text[i : i + size])) for i, h in enumerate(hashes)]


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each distinct window: size, hash, words and the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in word_blocks(batch.column(1), ALNUM):
                rows = [(batch.column(0)[row + i].as_py(), *w) for i in range(stop - row) for w in windows_of(words, words.first[i], words.first[i + 1], width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.int32()), pa.array(np.array([r[2] for r in rows], dtype=np.uint64).astype(np.int64)), pa.array([r[3] for r in rows], type=pa.binary())],
                    names=["item", "size", "hash", "words"],
                )

    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    each = items.mapInArrow(run, "item string, size int, hash long, words binary")
    return each.groupBy("size", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """The benchmark's windows, as the tasks look them up."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]):
        self.exact: dict[tuple[int, bytes], list[str]] = {(size, words): items for size, _, words, items in rows}
        self.bits: dict[int, np.ndarray] = {}
        by_size = defaultdict(list)
        for size, h, _, _ in rows:
            by_size[size].append(h)
        self.hashes = {size: np.unique(np.array(h, dtype=np.int64).view(np.uint64)) for size, h in by_size.items()}
        for size, h in self.hashes.items():
            self.bits[size] = np.zeros(1 << _BITS, dtype=bool)
            self.bits[size][h >> np.uint64(64 - _BITS)] = True

    def scan(self, words: Words) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document of the block, first word, words, items) of each verified occurrence."""
        for size, known in self.hashes.items():
            hashes = shingle_hashes(words.hashes, size)
            if not len(hashes):
                continue
            at = np.flatnonzero(self.bits[size][hashes >> np.uint64(64 - _BITS)])
            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
            doc = np.searchsorted(words.first, at, side="right") - 1
            inside = at + size <= words.first[doc + 1]  # not across two documents
            for d, i in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                text = b" ".join(words.bytes[s:e].tobytes() for s, e in zip(words.starts[i : i + size], words.ends[i : i + size], strict=True))
                items = self.exact.get((size, text))
                if items is not None:
                    yield d, i, size, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The first ``BITMAP_BITS`` bits of the windows' hashes as a bitmap, and the windows' sizes."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    longs = windows.select((place / 64).cast("long").alias("at"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITMAP_BITS}) % 64))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("bits"))
    found = longs.toPandas()  # 2**20 rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out, sorted(r["size"] for r in windows.select("size").distinct().collect())


def joined_hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """key, hits (first word and word after the last, in turn) and items, for each text (key, text) that has any."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            for row, _, words in word_blocks(batch.column(1), ALNUM):
                for size in sizes:
                    hashes = shingle_hashes(words.hashes, size)
                    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    at = np.flatnonzero(bits[place >> 6] >> (place & 63) & 1)
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + size <= words.first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    text = [b" ".join(words.bytes[s:e].tobytes() for s, e in zip(words.starts[i : i + size], words.ends[i : i + size], strict=True)) for i in at.tolist()]
                    columns = [batch.column(0).take(pa.array(row + doc)), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(text, type=pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "size", "hash", "words"])

    maybe = texts.mapInArrow(run, "key string, first int, size int, hash long, words binary")
    sure = salted(maybe.distinct(), windows, ["size", "hash", "words"], "key")
    return sure.groupBy("key").agg(F.flatten(F.collect_set(F.array("first", F.col("first") + F.col("size")))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", benchmark_text: str = "text", width: int = WIDTH, most: int = SET_WINDOWS) -> DataFrame:
    """The columns in ``keep``, n_words, n_hit, items (sorted, distinct) and spans (byte ranges to cut, end exclusive)."""
    windows = checkpointed(benchmark_windows(benchmark, item, benchmark_text, width))
    known = None
    hits, items = F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")
    if (windows.agg(F.sum(F.size("items"))).first()[0] or 0) <= most:
        known = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.size, r.hash, bytes(r.words), list(r["items"])) for r in windows.collect()]))
        out, place = with_text(docs, keep, text, hits.alias("__hits"), items.alias("__items"))
    else:
        # hits depend on the text alone
        keyed = F.md5(F.col(text).cast("binary"))
        texts = docs.where(F.col(text).isNotNull()).select(keyed.alias("key"), F.col(text).alias("text"))
        found = checkpointed(joined_hits(texts, windows)).select(F.col("key").alias("__key"), F.col("hits").alias("__hits"), F.col("items").alias("__items"))
        out, place = with_text(docs, keep, text, keyed.alias("__key"))
        names = [c for c in out.columns if c != "__key"]
        out = out.join(found, "__key", "left").select(*names, "__hits", "__items")
    n_carried = len(out.columns) - 2
    result = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(f"n_words long, n_hit long, items array<string>, spans {SPANS}").fields])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, before_hits, before_items = batch.column(place), batch.column(n_carried), batch.column(n_carried + 1)
            _, offsets = text_buffers(column)
            for row, stop, words in word_blocks(column, ALNUM):
                hits: list[list[int]] = [x or [] for x in before_hits.slice(row, stop - row).to_pylist()]
                items: list[set[str]] = [set(x or []) for x in before_items.slice(row, stop - row).to_pylist()]
                for d, i, size, found in known.value.scan(words) if known is not None else ():
                    i -= int(words.first[d])
                    hits[d] += [i, i + size]
                    items[d].update(found)
                merged = [merge_spans(list(zip(h[::2], h[1::2], strict=True))) for h in hits]
                spans = []
                for d, own in enumerate(merged):
                    first, base = int(words.first[d]), int(offsets[row + d] - offsets[row])
                    spans.append([{"start": int(words.starts[first + s]) - base, "end": int(words.ends[first + e - 1]) - base} for s, e in own])
                n_hit = pa.array([sum(e - s for s, e in own) for own in merged], type=pa.int64())
                kept = [batch.column(k).slice(row, stop - row) for k in range(len(keep))]
                listed = pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(words.first).astype(np.int64)), n_hit, listed, pa.array(spans, type=spans_type)], names=result.names)

    return out.mapInArrow(run, result)


def contaminated(share: int = 20) -> Column:
    """Whether at least one of ``share`` words is inside a test window."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
