r"""Target-distribution importance resampling: documents drawn by how much their hashed n-grams resemble a target's.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z; features are all runs of
1 to ``width`` words, joined by a blank, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. With S features of all documents, s in the bucket, T and t of all target texts, a bucket's gain is
floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). A document's weight is the floored mean of the gains of its
features; Gumbel noise from a hash of seed and id makes the highest scores a draw without replacement.

Texts are coded in blocks of ``CODED_BYTES`` against the block's own list of distinct words. The lists of all blocks make
one dictionary of integer ids; n-grams are tuples of ids. Each distinct tuple is put together from the dictionary and
hashed once, and its gain is joined back to the blocks that have it. A word is at most one row a block, so neither a
word nor a tuple can be hot, and texts aren't shuffled: their codes are, to meet what was looked up. The table of gains has
``buckets`` rows. Ranks come from a range partitioning by score and the number of rows of each range.

Null and empty texts, and those without words, have no features and the weight 0. Repeated rows are scored each and get
ranks of their own; rows of one id share their noise, and ties go to the smaller id, null ids last. Target rows with null
texts count nothing. An empty target or table of documents leaves the formula as it is. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import ALNUM, LOWER, row_blocks, text_buffers
from harrier.llm.components import checkpointed, salted, written
from harrier.llm.wordtable import CODED_BYTES, coded_words

BUCKETS = 10_000
SEED = "2024"
#: Only documents of so many words can be drawn, and so many of a hundred of them are.
LEAST_WORDS, PERCENT = 20, 10

_CODED = "block long, side int, lengths binary, codes binary, words array<string>, counts array<int>"


def coded_blocks(texts: DataFrame, side: int) -> DataFrame:
    """From (id, text): block, side, ids, lengths (words of each text) and codes (of all words, deflated), words (distinct) and their counts."""
    result = T.StructType([*T._parse_datatype_string(_CODED).fields, T.StructField("ids", T.ArrayType(texts.schema["id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33 | side << 32
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for row, stop in row_blocks(offsets, CODED_BYTES):
                at = offsets[row : stop + 1]
                low = LOWER[data[at[0] : at[-1]]]
                codes, words, first = coded_words(low, ALNUM[low], at - at[0])
                packed = zlib.compress(codes.astype(np.int32).tobytes(), 1)
                ids = batch.column("id").slice(row, stop - row)
                one = lambda values, kind: pa.array([values], type=kind)
                listed = pa.ListArray.from_arrays(pa.array([0, len(words)], type=pa.int32()), words.cast(pa.large_string()).cast(pa.string()))
                counts = pa.ListArray.from_arrays(pa.array([0, len(words)], type=pa.int32()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int32)))
                owners = pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([one(number, pa.int64()), one(side, pa.int32()), one(np.diff(first).astype(np.int32).tobytes(), pa.binary()), one(packed, pa.binary()), listed, counts, owners], names=result.names)
                number += 1

    return texts.select("id", "text").mapInArrow(run, result)


def grams_of(codes: np.ndarray, lengths: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size up to width: distinct tuples of codes (a row each), and the tuple, the document and the count of each (document, tuple)."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    rank, tuples = codes.astype(np.int64), np.arange(codes.max() + 1 if len(codes) else 0)[:, None]
    for size in range(1, width + 1):
        if size > 1:
            go_on = np.flatnonzero(np.arange(len(rank)) + size <= ends[doc[: len(rank)]])
            # ranks of tuples one shorter, and the next code, in one number
            base = int(codes.max()) + 1 if len(codes) else 1
            wide = np.full(len(codes), -1, dtype=np.int64)
            wide[go_on] = rank[go_on] * base + codes[go_on + size - 1]
            keys, inverse = np.unique(wide[go_on], return_inverse=True)
            tuples = np.column_stack([tuples[keys // base], keys % base])
            rank = np.full(len(codes), -1, dtype=np.int64)
            rank[go_on] = inverse
        place = np.flatnonzero(rank >= 0)
        pairs, count = np.unique(doc[place] * np.int64(max(1, len(tuples))) + rank[place], return_counts=True)
        yield tuples, pairs % max(1, len(tuples)), pairs // max(1, len(tuples)), count


def _block(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the one block in a table."""
    return np.frombuffer(zlib.decompress(row.column("codes")[0].as_py()), dtype=np.int32), np.frombuffer(row.column("lengths")[0].as_py(), dtype=np.int32)


def _in_order(found: pa.Table, value: str) -> np.ndarray:
    """The values of a block's rows by their place; every place has one."""
    out = np.empty(len(found), dtype=np.int64)
    out[found.column("place").to_numpy()] = found.column(value).to_numpy()
    return out


def block_grams(blocks: DataFrame, listed: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """block, side, place, gram (ids of words) and n, a row for each distinct tuple of a block.

    Tuples of one are the block's words; codes are only read for longer ones.
    """
    ids = listed.join(words, "word").select("block", "side", "place", "id", "n")
    single = ids.select("block", "side", "place", F.array("id").alias("gram"), "n")
    if width == 1:
        return single

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, lengths = _block(left)
        known, parts, place = _in_order(right, "id"), [], 0
        for tuples, which, _, count in grams_of(codes, lengths, width):
            size = len(tuples)
            if tuples.shape[1] > 1:
                n = np.bincount(which, weights=count, minlength=size).astype(np.int64)
                at = pa.array(np.arange(size + 1, dtype=np.int32) * tuples.shape[1])
                parts.append(pa.table({"block": pa.repeat(left.column("block")[0], size), "side": pa.repeat(left.column("side")[0], size), "place": pa.array(np.arange(place, place + size, dtype=np.int32)), "gram": pa.ListArray.from_arrays(at, pa.array(known[tuples.ravel()])), "n": pa.array(n)}))
            place += size
        return pa.concat_tables(parts)

    given = blocks.select("block", "side", "lengths", "codes").where(F.size("words") > 0)
    ids = ids.select(F.col("block").alias("of"), "place", "id")
    return single.unionByName(given.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(run, "block long, side int, place int, gram array<long>, n long"))


def hashed_grams(grams: DataFrame, words: DataFrame, width: int, buckets: int) -> DataFrame:
    """grams with ``bucket``: the CRC-32 of each one's words, put together from the dictionary."""
    out = None
    for size in range(1, width + 1):
        part = grams.where(F.size("gram") == size)
        for i in range(size):
            part = part.withColumn("id", F.get("gram", F.lit(i)))
            one = words.select("id", F.col("word").alias(f"w{i}"))
            # tuples of one word are distinct in it; a word may be in any share of the longer ones
            part = (part.join(one, "id") if size == 1 else salted(part, one, "id", "gram")).drop("id")
        text = F.concat_ws(" ", *(f"w{i}" for i in range(size)))
        part = part.select(*grams.columns, F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))
        out = part if out is None else out.unionByName(part)
    return out


def gains(grams: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of all buckets that documents or target use."""
    sums = grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = grams.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    double = lambda c: c.cast("double")
    share = double(F.col("t") + 1) * double(F.col("all_s") + buckets) / (double(F.col("s") + 1) * double(F.col("all_t") + buckets))
    return sums.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(share) * 1000.0).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and weight, a row for each row of docs."""
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    aim = target.select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), F.col(target_text).alias("text")).where("text IS NOT NULL")
    blocks = written(coded_blocks(own, 0).unionByName(coded_blocks(aim, 1)))
    listed = blocks.select("block", "side", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("block", "side", "place", F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("n"))
    words = checkpointed(listed.select("word").distinct()).withColumn("id", F.monotonically_increasing_id())
    grams = written(block_grams(blocks, listed, words, width))
    of_side = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    distinct = grams.groupBy("gram").agg(of_side(0).alias("s"), of_side(1).alias("t"))
    distinct = written(hashed_grams(distinct, words, width, buckets))
    # at most one row for each bucket
    gained = distinct.join(F.broadcast(gains(distinct, buckets)), "bucket").select("gram", "gain")
    found = grams.where("side = 0").join(gained, "gram").select(F.col("block").alias("of"), "place", "gain")
    result = T.StructType([T.StructField("id", own.schema["id"].dataType), *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, lengths = _block(left)
        total, features, place = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
        gain = _in_order(right, "gain")
        for tuples, which, doc, count in grams_of(codes, lengths, width):
            np.add.at(total, doc, gain[place + which] * count)
            np.add.at(features, doc, count)
            place += len(tuples)
        weight = np.floor_divide(total, np.maximum(features, 1))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(lengths.astype(np.int64)), pa.array(features), pa.array(weight)], names=result.names)

    given = blocks.where("side = 0").select("block", "lengths", "codes", "ids")
    return given.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, result)


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))) of the first 32 bits h of a digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """rows with their place in an order, from 1, and how many there are.

    Ranges of the order are sorted each by itself; the driver sees their sizes only.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33).cast("int"))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    out = placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return out.select(*rows.columns, name), total


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = 1, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null: not drawn), a row for each row of docs."""
    scored = weights(docs, target, key, text, target_text, width, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = checkpointed(scored)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    may, n = ranked(scored.where(F.col("n_words") >= least_words), order, "rank")
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return may.withColumn("rank", drawn).unionByName(rest)
