"""Substring dedup by content-defined chunks of a gear rolling hash.

A chunk ends where the gear hash of the last ``WINDOW`` bytes falls in one of ``1 / 16`` of its values and the chunk
has ``SHORTEST`` bytes at least; where none does within ``LONGEST`` bytes, it ends at their lowest hash (the first of
equal ones). Boundaries depend on nearby bytes only, so a passage is cut alike wherever it stands, and an insertion
disturbs the chunks next to it alone. Chunks are short (about 23 bytes), so single ones recur by chance; a *block* is
``CHUNKS_PER_BLOCK`` consecutive chunks. Of every two neighbouring blocks that with the lower digest is taken, so a
passage with three whole chunks has one, and blocks are compared by a 64-bit digest.

Blocks that occur in more than one document are merged to runs, whichever documents share each. A run that may or may not have more than ``words``
words, given the text of up to ``CONTEXT`` bytes on either side, is extended byte by byte against the text of a
document that shares its first block, and of one that shares its last, and its whole common words are counted. Runs
of more words are repeats. The first document (the smallest id and text hash) keeps a repeat; the others may cut it.
The edges of runs that are long enough without it stay at chunk edges.

Offsets are in bytes, ends exclusive. Repeats within one document only don't count. Null and empty texts and rows
with a null id have no spans. Rows of one id and text count once. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import NOT_SPACE, prefix_hash, row_blocks, seeded, shingle_hashes, span_hash, text_buffers
from harrier.llm.components import checkpointed

WINDOW = 16
SHORTEST, LONGEST = 8, 64
BOUNDARY = np.uint16(0xF000)
CHUNKS_PER_BLOCK = 2
#: Bytes on either side of a run in which it may be extended.
CONTEXT = 2 * LONGEST
#: A repeat has more words.
WORDS = 50
#: Blocks that a thousandth of the documents have, by a sample of every 64th id, are dealt over so many tasks each; at
#: most ``FREQUENT`` are. The sample decides about nothing else.
SALTS = 64
FREQUENT = 10_000

_GEAR = (seeded(303, 256) & np.uint64(0xFFFF)).astype(np.uint16)
_BYTE = seeded(404, 256)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte, sum of GEAR[byte i steps back] << i, by doubling the window."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint16(shift))
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """The ends of a text's chunks."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    gear = gear_hash(data)
    ends, last = [], 0
    for at in (np.flatnonzero((gear & BOUNDARY) == 0) + 1).tolist() + [len(data)]:
        while at - last > LONGEST:
            last += SHORTEST + int(gear[last + SHORTEST - 1 : last + LONGEST].argmin())
            ends.append(last)
        if at - last >= SHORTEST or at == len(data) and at > last:
            ends.append(at)
            last = at
    return np.array(ends, dtype=np.int64)


def blocks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """digest, span (start << 32 | end), words (begun before the start << 32 | before the end) and near (words begun
    within ``CONTEXT`` bytes before << 16 | after) of each block of a text that is taken."""
    ends = boundaries(data)
    if not len(ends):
        return (np.zeros(0, dtype=np.int64),) * 4
    starts = np.concatenate([[0], ends[:-1]])
    chunks = span_hash(prefix_hash(_BYTE[data]), starts, ends)
    digests = shingle_hashes(chunks, CHUNKS_PER_BLOCK)
    n = len(digests)
    low = digests[1:] <= digests[:-1]
    taken = np.zeros(n, dtype=bool)
    taken[1:] |= low
    taken[: n - 1] |= ~low
    taken |= n == 1
    at = np.flatnonzero(taken)
    inside = NOT_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    words = np.concatenate([[0], np.cumsum(begins)])
    start, end = starts[at], ends[at + CHUNKS_PER_BLOCK - 1]
    before, after = words[start] - words[np.maximum(start - CONTEXT, 0)], words[np.minimum(end + CONTEXT, len(data))] - words[end]
    return digests[at].view(np.int64), start << 32 | end, words[start] << 32 | words[end], before << 16 | after


def block_rows(docs: DataFrame) -> DataFrame:
    """From (id, text_hash, text): digest, id, text_hash, span, words and near of each block."""
    names = ["digest", "id", "text_hash", "span", "words", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for row, stop in row_blocks(offsets):
                parts = [blocks_of(data[offsets[i] : offsets[i + 1]]) for i in range(row, stop)]
                owner = pa.array(np.repeat(np.arange(row, stop), [len(p[0]) for p in parts]))
                digest, *at = (pa.array(np.concatenate([p[k] for p in parts])) for k in range(4))
                yield pa.RecordBatch.from_arrays([digest, batch.column(0).take(owner), batch.column(1).take(owner), *at], names=names)

    kinds = {"id": docs.schema["id"].dataType}
    return docs.select("id", "text_hash", "text").mapInArrow(run, T.StructType([T.StructField(n, kinds.get(n, T.LongType()), nullable=False) for n in names]))


def frequent(docs: DataFrame) -> DataFrame:
    """The digests of blocks that many documents have, at most ``FREQUENT``."""
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0)
    counts = block_rows(sample).groupBy("digest").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(32), F.lit(sample.count() / 1000))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "digest").limit(FREQUENT).select("digest", F.lit(True).alias("hot"))


def shared_blocks(docs: DataFrame) -> DataFrame:
    """id, text_hash, span, words and near of each block that another document has too, its partner (id, text_hash, span
    of the first document that has the block, or for that one of the last) and whether that is an earlier one (cut)."""
    hot = checkpointed(frequent(docs))
    salt = F.coalesce(F.when(F.col("hot"), F.pmod(F.xxhash64("text_hash"), F.lit(SALTS)) + 1), F.lit(0).cast("long"))
    # one shuffle: blocks are grouped and joined where they lie (keys that can't be null keep Spark from a filter in one branch)
    dealt = block_rows(docs).join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).drop("hot").repartition("digest", "salt")
    whole = F.struct("id", "text_hash", "span", "words", "near")
    ends = [F.min("first").alias("first"), F.max("last").alias("last")]
    parts = dealt.groupBy("digest", "salt").agg(F.min(whole).alias("first"), F.max(whole).alias("last"), F.max("salt").alias("piece"))
    joined = dealt.join(parts.where("piece > 0 OR first.id != last.id").drop("piece"), ["digest", "salt"])
    spread = parts.where("piece > 0").groupBy("digest").agg(*ends).select("digest", F.col("first").alias("first_of_all"), F.col("last").alias("last_of_all"))
    joined = joined.join(F.broadcast(spread), "digest", "left").withColumns({"first": F.coalesce("first_of_all", "first"), "last": F.coalesce("last_of_all", "last")}).where("first.id != last.id")
    mine = F.col("first.id") == F.col("id")
    other = F.when(mine, F.col("last")).otherwise(F.col("first"))
    return joined.select("id", "text_hash", "span", "words", "near", other["id"].alias("other_id"), other["text_hash"].alias("other_hash"), other["span"].alias("other_span"), (~mine).alias("cut"))


def runs(blocks: DataFrame) -> DataFrame:
    """The blocks of a document merged where they meet: id, text_hash, cut, start, end, words, before and after, and
    left and right, the partners (id, text_hash, at) at the start and at the end. Once for all shared blocks, and once
    for those that an earlier document has (cut)."""
    low, high = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    order = Window.partitionBy("id", "text_hash").orderBy("span")
    start, end = low("span"), high("span")
    numbered = blocks
    for name, use in (("all", F.lit(True)), ("cut", F.col("cut"))):
        reach = F.max(F.when(use, end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        numbered = numbered.withColumn("new", (use & F.coalesce(start > reach, F.lit(True))).cast("int")).withColumn(f"run_{name}", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda at: F.struct(F.col("other_id").alias("id"), F.col("other_hash").alias("text_hash"), at.alias("at"))
    kinds = F.array(F.struct(F.lit(False).alias("cut"), F.col("run_all").alias("run")), F.struct(F.lit(True).alias("cut"), F.col("run_cut").alias("run")))
    each = numbered.withColumn("kind", F.explode(F.when(F.col("cut"), kinds).otherwise(F.slice(kinds, 1, 1)))).drop("cut")
    merged = each.groupBy("id", "text_hash", "kind.cut", "kind.run").agg(
        F.min(start).alias("start"),
        F.max(end).alias("end"),
        (F.max(high("words")) - F.min(low("words"))).alias("words"),
        F.min(F.struct(start.alias("start"), F.shiftright("near", 16).alias("words"), side(low("other_span")).alias("at"))).alias("left"),
        F.max(F.struct(end.alias("end"), F.col("near").bitwiseAND(F.lit(0xFFFF)).alias("words"), side(high("other_span")).alias("at"))).alias("right"),
    )
    return merged.select("id", "text_hash", "cut", "start", "end", "words", F.col("left.words").alias("before"), F.col("right.words").alias("after"), F.col("left.at").alias("left"), F.col("right.at").alias("right"))


def contexts(docs: DataFrame, points: DataFrame) -> DataFrame:
    """The text beside each point (id, text_hash, at, right) of a document: from the run's byte next to the point outwards,
    up to ``CONTEXT`` bytes and a blank where the text ends."""
    kind = T.StructType([docs.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("at", T.LongType()), T.StructField("right", T.BooleanType()), T.StructField("beside", T.BinaryType())])

    def beside(text: bytes, at: int, right: bool) -> bytes:
        found = text[at - 1 : at + CONTEXT] if right else text[max(at - CONTEXT, 0) : at + 1][::-1]
        return found if len(found) > CONTEXT else found + b" "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i in range(batch.num_rows):
                text, places = data[offsets[i] : offsets[i + 1]].tobytes(), batch.column(3)[i].as_py()
                one = pa.array(np.full(len(places), i))
                found = [beside(text, p["at"], p["right"]) for p in places]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(one), batch.column(1).take(one), pa.array([p["at"] for p in places], type=pa.int64()), pa.array([p["right"] for p in places]), pa.array(found, type=pa.binary())], names=kind.names)

    # distinct points of a document are bounded by its length
    listed = points.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "right")).alias("points"))
    return docs.join(listed, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", "text", "points").mapInArrow(run, kind)


def _word(text: bytes, i: int) -> bool:
    return i < len(text) and text[i] not in b" \t\n\x0b\x0c\r"


def further(a: bytes, b: bytes, right: bool) -> tuple[int, int]:
    """By how many bytes two runs go on alike, given what is beside them (from the last byte of the run outwards), and how
    many more words the run then has, a word that is cut short at its edge being none."""
    n = 0
    while n + 1 < min(len(a), len(b)) and a[n + 1] == b[n + 1]:
        n += 1
    if right:
        ends = lambda i: _word(a, i) and not _word(a, i + 1) and not _word(b, i + 1)
        while n and not ends(n):
            n -= 1  # back to where a word ends in both
        begun = sum(_word(a, i) and not _word(a, i - 1) for i in range(1, n + 1))
        return n, begun - (not n and _word(a, 0) and not ends(0))
    while n and not (_word(a, n) and not _word(a, n + 1) and not _word(b, n + 1)):
        n -= 1  # back to where a word begins in both
    return n, sum(_word(a, i) and not _word(a, i + 1) for i in range(1, n + 1)) - (not n and _word(a, 0) and not _word(a, 1) and _word(b, 1))


def extended(uncertain: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The runs that have more than ``words`` whole words in common with a partner, extended to their true edges."""
    place = lambda at: F.struct("id", "text_hash", F.col(at).alias("at"))
    sides = [(place("start"), False, "a"), (F.col("left"), False, "b"), (place("end"), True, "c"), (F.col("right"), True, "d")]
    points = [uncertain.select(s["id"].alias("id"), s["text_hash"].alias("text_hash"), s["at"].alias("at"), F.lit(r).alias("right")) for s, r, _ in sides]
    beside = checkpointed(contexts(docs, reduce(DataFrame.unionByName, points).distinct()))
    rows = uncertain
    for s, r, name in sides:
        keys = {f"__{k}": s[k] for k in ("id", "text_hash", "at")}
        few = beside.where(F.col("right") == F.lit(r)).select(*(F.col(k[2:]).alias(k) for k in keys), F.col("beside").alias(name))
        rows = rows.withColumns(keys).join(few, [*keys]).drop(*keys)

    @F.pandas_udf("start long, end long, words long")
    def edges(start: pd.Series, end: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        left, right = ([further(x, y, r) for x, y in zip(p, q, strict=True)] for p, q, r in ((a, b, False), (c, d, True)))
        more = np.array([(x, y, i + j) for (x, i), (y, j) in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"start": start - more[:, 0], "end": end + more[:, 1], "words": n + more[:, 2]})

    found = rows.select("id", "text_hash", "cut", edges("start", "end", "words", "a", "b", "c", "d").alias("e"))
    return found.select("id", "text_hash", "cut", "e.*").where(F.col("words") > words)


SPAN = "array<struct<start: bigint, end: bigint, words: bigint>>"


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id, text_hash, n_bytes, repeats (all repeated spans of more than ``words`` words) and cuts (those that an earlier
    document keeps), a row for each row."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    usable = rows.where("id IS NOT NULL")
    found = checkpointed(runs(shared_blocks(usable)).where(F.col("words") + F.col("before") + F.col("after") > words))
    # the first and the last word of a run may not be whole
    sure = F.col("words") - 2 > words
    spans = found.where(sure).select("id", "text_hash", "cut", "start", "end", "words").unionByName(extended(found.where(~sure), usable, words))
    span = F.struct("start", "end", "words")
    lists = spans.groupBy("id", "text_hash").agg(*(F.sort_array(F.collect_set(F.when(c, span))).alias(name) for name, c in (("repeats", ~F.col("cut")), ("cuts", F.col("cut")))))
    sizes = rows.select("id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = sizes.join(lists, ["id", "text_hash"], "left")
    return joined.select("id", "text_hash", "n_bytes", *(F.coalesce(c, F.array().cast(SPAN)).alias(c) for c in ("repeats", "cuts")))


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """A text without the given byte spans, which are in order and may overlap."""
    out, at = [], 0
    for start, end in cuts:
        out.append(text[at : max(start, at)])
        at = max(at, end)
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts drawn in to where characters begin."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for start, end in cuts:
        while inside(start):
            start += 1
        while inside(end):
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the cuts taken out of the text."""
    cuts = found.where(F.size("cuts") > 0).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))).alias("__cuts")).distinct()

    def without(text: bytes, spans: list[tuple[int, int]]) -> str:
        return cut_text(text, whole_characters(text, spans)).decode("utf-8")

    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([v if v is None or not len(s) else without(v.encode("utf-8"), [(c["start"], c["end"]) for c in s]) for v, s in zip(values, spans, strict=True)])

    joined = docs.join(cuts, (F.col(key) == F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hash")), "left")
    changed = apply(F.col(text), F.coalesce("__cuts", F.array().cast("array<struct<start: bigint, end: bigint>>")))
    return joined.withColumn(text, changed).drop("__id", "__hash", "__cuts")
