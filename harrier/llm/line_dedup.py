r"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case. A key of at least
``LEAST_CHARS`` code points that at least ``LEAST_DOCS`` documents hold loses all its lines but those of the largest
id that holds it.

Rows of a 128-bit hash of the key (in two halves), id and place are dealt in ranges of (hash, id falling, place) and sorted within.
A task streams its range: the first id of a key is the one that keeps it, and from the ``LEAST_DOCS``-th id on the
others' lines are lost. It holds the lines of less than ``LEAST_DOCS`` documents at a time. A range may begin or end
within a key, so a key that a third of all lines have is spread over many tasks; the rows of such keys stay open, and
the tasks leave one summary of each (first and last id, number of ids), two a range at most, which settles them. What
comes out are keep bitmaps, deflated, for each (id, text) that loses lines; texts aren't shuffled until they are applied.

Null and empty texts are one empty line. Rows of one id are one document when documents are counted, and rows with equal
id and text get equal results. A row whose id is null is left as it is and not counted. Extra columns, of any name, aren't
read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import row_blocks, text_buffers
from harrier.llm.components import checkpointed

LEAST_CHARS = 40
LEAST_DOCS = 5
WHITE = b" \t\n\x0b\x0c\r"
#: States of the rows that a task leaves.
LOST, OPEN, SUMMARY = 0, 1, 2


def long_lines(text: bytes, least_chars: int) -> Iterator[tuple[int, bytes]]:
    """Place and key of the lines of UTF-8 text whose keys are long enough."""
    for i, line in enumerate(text.lower().split(b"\n")):  # of bytes, only A-Z
        line = line.strip(WHITE)
        if len(line) >= least_chars and (line.isascii() or len(line.decode()) >= least_chars):
            yield i, line


def keyed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """id, text_hash, n_lines, line (its place, from 0), h1 and h2, a row for each line that is long enough."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL").select("id", F.xxhash64("text").alias("text_hash"), "text")
    result = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string("text_hash long, n_lines int, line int, h1 long, h2 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for row, stop in row_blocks(offsets):
                owner, place, digests, n_lines = [], [], [], []
                for i in range(row, stop):
                    own = data[offsets[i] : offsets[i + 1]].tobytes()
                    n_lines.append(own.count(b"\n") + 1)
                    for line, found in long_lines(own, least_chars):
                        owner.append(i)
                        place.append(line)
                        digests.append(xxhash.xxh3_128_digest(found))
                h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                at = pa.array(owner, type=pa.int64())
                lines = pa.array(np.array(n_lines, dtype=np.int32)[np.array(owner, dtype=np.int64) - row])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("text_hash").take(at), lines, pa.array(place, type=pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=result.names)

    return rows.mapInArrow(run, result)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    return np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False), dtype=bool)


class RangeStream:
    """Streams one sorted range. ``feed`` takes batches and gives (rows, states); ``ends`` has the summaries after ``close``."""

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.held: pa.RecordBatch | None = None
        self.done = np.zeros(0, dtype=bool)  # held rows that are settled or given out already
        self.rank = 1  # of the first held row's document within its key
        self.first: tuple[int, int] | None = None
        self.start: object = None  # the first id of the key that is open at the end
        self.ends: list[tuple[int, int, object, object, int]] = []

    def feed(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        if not len(batch):
            return
        n_held = 0 if self.held is None else len(self.held)
        rows = batch if self.held is None else pa.concat_batches([self.held, batch])
        done = np.concatenate([self.done, np.zeros(len(batch), dtype=bool)])
        ids, h1, h2 = rows.column("id"), rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
        new_key = np.ones(len(rows), dtype=bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= _changes(ids)
        starts = np.flatnonzero(new_key)
        group, count = np.cumsum(new_key) - 1, np.cumsum(new_doc)
        rank = count - count[starts][group] + 1
        if n_held:
            rank[group == 0] += self.rank - 1
        else:
            self.first, self.start = (int(h1[0]), int(h2[0])), ids[0].as_py()
        stops = np.append(starts[1:], len(rows))
        docs = rank[stops - 1]
        state = np.full(len(rows), -1)
        state[(rank > 1) & (docs >= self.least)[group] & ~done] = LOST
        leading = (h1[0], h2[0]) == self.first
        if leading:
            state[: stops[0]] = np.where(done[: stops[0]], -1, OPEN)
            if len(starts) > 1:
                self.ends.append((*self.first, self.start, ids[int(stops[0]) - 1].as_py(), int(docs[0])))
                self.first = None
        if len(starts) > 1:
            self.start = ids[int(starts[-1])].as_py()
        out = np.flatnonzero(state >= 0)
        if len(out):
            yield rows.take(pa.array(out)), state[out]
        # the last key may go on: its count, and what isn't settled
        at, last = int(starts[-1]), len(rows) - 1
        if docs[-1] < self.least and self.first is None:
            waiting = np.flatnonzero((np.arange(len(rows)) > at) & (rank > 1) & ~done)
            keep = np.concatenate([[at], waiting])
        else:
            keep = np.array([last])
        self.rank = int(rank[keep[0]])
        self.held = rows.take(pa.array(keep))
        self.done = np.zeros(len(keep), dtype=bool)
        self.done[0] = True
        self.n_docs, self.last = int(docs[-1]), ids[last].as_py()

    def close(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        if self.held is None:
            return
        waiting = np.flatnonzero(~self.done)
        if len(waiting):
            yield self.held.take(pa.array(waiting)), np.full(len(waiting), OPEN)
        self.ends.append((self.held.column("h1")[0].as_py(), self.held.column("h2")[0].as_py(), self.start, self.last, self.n_docs))


def marks(lines: DataFrame, least_docs: int) -> DataFrame:
    """What the ranges leave: lost and open lines, and the summaries of keys at their ends."""
    order = [F.col("h1"), F.col("h2"), F.col("id").desc(), F.col("line")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = lines.schema["id"].dataType
    result = T.StructType([*(T.StructField(f.name, f.dataType) for f in lines.schema), T.StructField("last_id", id_type), T.StructField("n_docs", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("state", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part = RangeStream(least_docs), TaskContext.get().partitionId()
        names, kinds = None, None

        def marked(rows: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(n, rows.schema.field("id").type), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, dtype=np.int32)), pa.array(state.astype(np.int32))], names=result.names)

        for batch in batches:
            names, kinds = batch.schema.names, batch.schema.types
            for rows, state in stream.feed(batch):
                yield marked(rows, state)
        for rows, state in stream.close():
            yield marked(rows, state)
        if stream.ends:
            given = dict(zip(("h1", "h2", "id"), zip(*(e[:3] for e in stream.ends), strict=True), strict=True))
            columns = [pa.array(given[c], type=kind) if c in given else pa.nulls(len(stream.ends), kind) for c, kind in zip(names, kinds, strict=True)]
            more = [pa.array([e[3] for e in stream.ends], type=kinds[names.index("id")]), pa.array([e[4] for e in stream.ends], type=pa.int64())]
            rest = [pa.array([part] * len(stream.ends), type=pa.int32()), pa.array([SUMMARY] * len(stream.ends), type=pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *more, *rest], names=result.names)

    return dealt.mapInArrow(run, result)


def lost_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, text_hash, n_lines and line of the lines to drop."""
    found = checkpointed(marks(keyed_lines(docs, key, text, least_chars), least_docs))
    in_turn = Window.partitionBy("h1", "h2").orderBy("part", F.col("id").desc())
    again = F.coalesce((F.lag("last_id").over(in_turn) == F.col("id")).cast("int"), F.lit(0))
    ends = found.where(F.col("state") == SUMMARY).withColumn("again", again)
    ends = ends.groupBy("h1", "h2").agg(F.max("id").alias("top"), F.sum(F.col("n_docs") - F.col("again")).alias("all_docs")).where(F.col("all_docs") >= least_docs)
    # two rows for each range at most
    settled = found.where(F.col("state") == OPEN).join(F.broadcast(ends), ["h1", "h2"]).where("id != top")
    columns = ("id", "text_hash", "n_lines", "line")
    return found.where(F.col("state") == LOST).select(*columns).unionByName(settled.select(*columns))


def pack(lost: np.ndarray, n_lines: int) -> bytes:
    """A deflated bitmap of n_lines bits, 0 for the lost ones."""
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[lost] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, text_hash, n_lines, n_dropped and keep (a deflated bitmap of the lines that stay) of each (id, text) that loses lines."""
    lost = lost_lines(docs, key, text, least_chars, least_docs)
    # sixty-four lines to a number, so that what is gathered of a document is small
    words = lost.groupBy("id", "text_hash", "n_lines", F.floor(F.col("line") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, line % 64))").alias("bits"))
    each = words.groupBy("id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.collect_list("at").alias("at"), F.collect_list("bits").alias("bits"))
    result = T.StructType([*each.select("id", "text_hash", "n_lines", "n_dropped").schema.fields, T.StructField("keep", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, at, bits in zip(batch.column("n_lines").to_pylist(), batch.column("at"), batch.column("bits"), strict=True):
                set_bits = np.unpackbits(bits.values.to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                word, bit = np.nonzero(set_bits)
                maps.append(pack(at.values.to_numpy()[word].astype(np.int64) * 64 + bit, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in result.names[:-1]), pa.array(maps, type=pa.binary())], names=result.names)

    return each.mapInArrow(run, result)


def kept_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, n_lines (before), n_dropped and text (the lines that stay), one row a document."""
    maps = keep_bitmaps(docs, key, text, least_chars, least_docs).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "n_dropped", "keep")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(maps, (F.col("id") == F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("id", "text", "n_dropped", "keep")
    result = T.StructType([joined.schema["id"], *T._parse_datatype_string("n_lines long, n_dropped long, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n_lines = pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1)
            maps, out = batch.column("keep"), []
            for i in np.flatnonzero(maps.is_valid().to_numpy(zero_copy_only=False)).tolist():
                lines = texts[i].as_py().split("\n")
                out.append((i, "\n".join(x for x, stays in zip(lines, unpack(maps[i].as_py(), len(lines)).tolist(), strict=True) if stays)))
            if out:
                texts = pc.replace_with_mask(texts, maps.is_valid(), pa.array([x for _, x in out], type=texts.type))
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_lines, batch.column("n_dropped").fill_null(0), texts], names=result.names)

    return joined.mapInArrow(run, result)
