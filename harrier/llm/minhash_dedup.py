"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds the hashes of its distinct runs of ``width`` words (the whole sequence if it has fewer);
its signature has ``COORDINATES`` minima. Documents with equal sets are one node. Every node is posted under each
(coordinate, value) of its signature. Nodes of similarity s agree in a binomial number of coordinates, so pairs
at the wanted similarity have at least T = ``threshold(...)`` collisions but for a chance below 1e-5.

*Prefix*: order a node's postings from the rarest to the most frequent; two nodes with T collisions share one of
the first ``COORDINATES - T + 1``, so lists are merged over that prefix only, and a node with fewer than T shared
values has no partner at all. *Skip*: a list whose nodes are already in one component is skipped. Lists are first
merged against one leader each (linear work); lists that still span several
components get further leaders while that would need too many comparisons, and then all their pairs between
components are compared, in units of two blocks of ``BLOCK`` nodes of a list, so that no component is missed, whatever
the length of the lists, and no task holds a long one.

Every candidate with T collisions is confirmed on the full sets: linked if 100 * |A & B| >= percent * |A | B|.

Null and empty texts have an empty set and are linked with nothing; so are rows with a null id, whose component
is null and which are kept. Rows of one id are one document: it has the links of each of its texts, so those with
words share a component, and ``n_shingles`` is that of the row's own text. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import NOT_SPACE, seeded, shingle_hashes, word_blocks
from harrier.llm.components import checkpointed, connected_components, salted

COORDINATES = 32
MISS = 1e-5
#: Rounds of leaders at most, and comparisons per posting at which all pairs between components are compared instead,
#: as they are when a round of leaders has not halved them.
LEADER_ROUNDS = 4
PAIRS_PER_POSTING = 200
BLOCK = 512

_A = seeded(101, COORDINATES) | np.uint64(1)
_B = seeded(202, COORDINATES)
_LANES = [f"s{i}" for i in range(COORDINATES // 2)]


def threshold(percent: int) -> int:
    """The largest T such that a pair of that similarity has fewer than T collisions with a chance below ``MISS``."""
    s, tail = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        tail += comb(COORDINATES, t) * s**t * (1 - s) ** (COORDINATES - t)
        if tail >= MISS:
            return max(t, 1)
    return COORDINATES


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a sequence of word hashes."""
    return np.unique(shingle_hashes(hashes, min(width, len(hashes)))) if len(hashes) else np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``COORDINATES`` unsigned 32-bit minima of a set that isn't empty."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        np.minimum(least, ((part[None, :] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, text_hash, n_shingles, d0 and d1 (a 128-bit digest of the set) and the signature, two coordinates to a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in word_blocks(batch.column(1), NOT_SPACE):
                sizes, digests, sigs = [], [], []
                for first, last in zip(words.first, words.first[1:], strict=False):
                    shingles = shingle_set(words.hashes[first:last], width)
                    sizes.append(len(shingles))
                    digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64) if len(shingles) else None)
                    sigs.append(signature(shingles).view(np.int64) if len(shingles) else None)
                lanes = [pa.array([None if s is None else int(s[i]) for s in sigs], type=pa.int64()) for i in range(len(_LANES))]
                halves = [pa.array([None if d is None else int(d[i]) for d in digests], type=pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), batch.column(2).slice(row, stop - row), pa.array(sizes, type=pa.int64()), *halves, *lanes], names=["id", "text_hash", "n_shingles", "d0", "d1", *_LANES])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("text_hash", "n_shingles", "d0", "d1", *_LANES))])
    return docs.select(key, text, F.xxhash64(text).alias("__hash")).mapInArrow(run, schema)


def sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """From (node, text): node and its set as packed sorted unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in word_blocks(batch.column(1), NOT_SPACE):
                packed = [shingle_set(words.hashes[a:b], width).tobytes() for a, b in zip(words.first, words.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(packed, type=pa.binary())], names=["node", "shingles"])

    return docs.select("node", text).mapInArrow(run, T.StructType([docs.schema["node"], T.StructField("shingles", T.BinaryType())]))


def collisions(a: str, b: str) -> Column:
    """How many coordinates two nodes have in common, given the prefixes of their signature columns."""
    total = F.lit(0)
    for lane in _LANES:
        x = F.col(a + lane).bitwiseXOR(F.col(b + lane))
        total = total + (x.bitwiseAND(F.lit(0xFFFFFFFF)) == 0).cast("int") + (F.shiftrightunsigned(x, 32) == 0).cast("int")
    return total


def prefix_postings(nodes: DataFrame, least: int) -> DataFrame:
    """(key, node) for the postings in each node's prefix that another node has too."""
    keys = []
    for i, lane in enumerate(_LANES):
        low, high = F.col(lane).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(lane), 32)
        keys += [low + F.lit(2 * i << 32), high + F.lit((2 * i + 1) << 32)]
    postings = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = postings.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    prefix = lists.where(F.size("own") >= least).select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("p"))
    return prefix.select(F.col("p.key").alias("key"), "node")


def _with_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _LANES)), side)
    return pairs


def measure(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets and of what is common to both: a, b, a_size, b_size, common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                sizes[:, i] = len(x), len(y), len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(n) for n in sizes)], names=["a", "b", "a_size", "b_size", "common"])

    right = pairs.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = right.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    sizes = [T.StructField(c, T.LongType()) for c in ("a_size", "b_size", "common")]
    return both.select("a", "b", "x", "y").mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"], *sizes]))


def similar(common: Column, percent: int) -> Column:
    """Whether sets with so many common shingles are similar enough."""
    return 100 * common >= percent * (F.col("a_size") + F.col("b_size") - common)


def private_counts(shingles: DataFrame, percent: int) -> DataFrame:
    """node, size of its set, and own, how many of its shingles no other candidate has, where a partner is possible.

    A partner shares percent of the set at least; a node with more shingles of its own has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                parts = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1).slice(i, 256)]
                owner = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256).take(owner), pa.array(np.concatenate(parts))], names=["node", "shingle"])

    each = shingles.select("node", "shingles").mapInArrow(run, T.StructType([shingles.schema["node"], T.StructField("shingle", T.LongType())]))
    single = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    own = single.groupBy("node").agg(F.count("*").alias("own"))
    sized = shingles.select("node", (F.octet_length("shingles") / 8).cast("long").alias("size"))
    counts = sized.join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    return counts.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))


def possible(percent: int) -> Column:
    """Whether two nodes can be similar enough, given their sizes and how many shingles each has of its own."""
    most = F.least(F.col("a_size") - F.col("a_own"), F.col("b_size") - F.col("b_own"))
    return similar(most, percent) & (100 * most >= percent * F.greatest(F.col("a_size") + F.col("b_own"), F.col("b_size") + F.col("a_own")))


def possible_by_leader(percent: int) -> Column:
    """The same, given what each has in common with the leader of a list: both share no more of the leader's set than
    the one that shares less, and outside it no more than what isn't the other's own."""
    outside = F.least(*(F.col(f"{s}_size") - F.col(f"{s}_common") - F.col(f"{s}_own") for s in "ab"))
    return F.coalesce(similar(F.least("a_common", "b_common") + outside, percent), F.lit(True))


def block_pairs(rest: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of a list (key, node, component, size, own, common, keys) that may be similar, once each.

    A list of n nodes is dealt in n / ``BLOCK`` blocks; every two blocks meet in a unit of their own.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rest.join(sizes.select("key", parts.alias("parts")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    values = ("node", "component", "size", "own", "common", "keys")
    columns = lambda s: [F.col(c).alias(f"{s}_{c}") for c in values]
    left = dealt.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("parts") - 1)).alias("j"), *columns("a"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *columns("b"))
    # a pair that shares several lists is taken from the first of them
    first = F.array_min(F.array_intersect("a_keys", "b_keys")) == left["key"]
    once = F.when(left["i"] < left["j"], F.col("a_component") != F.col("b_component")).otherwise(F.col("a_component") < F.col("b_component"))
    on = (left["key"] == right["key"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    return left.join(right, on & once & possible(percent) & possible_by_leader(percent) & first).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def link(docs: DataFrame, nodes: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b) edges between the nodes (node, id and text_hash of a document that has the set, signature)."""
    least = threshold(percent)
    postings = checkpointed(prefix_postings(nodes, least))
    candidates = nodes.select("node", "id", "text_hash").join(postings.select("node").distinct(), "node")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text")).join(candidates, ["id", "text_hash"])
    shingles = checkpointed(sets(texts, "__text", width).dropDuplicates(["node"]))
    counts = checkpointed(private_counts(shingles, percent))
    postings = checkpointed(postings.join(counts, "node"))
    total = postings.count()
    lists, before = postings.withColumn("component", F.col("node")), 0.0
    edges = leaders = measured = None
    for turn in range(LEADER_ROUNDS + 1):
        parts = lists.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("parts"))
        open_keys = parts.where("parts > 1")
        work = open_keys.agg(F.sum(F.expr("double(n) * n - own") / 2)).first()[0] or 0.0
        if not work:
            break
        rest = lists.join(open_keys.select("key"), "key")
        last = turn == LEADER_ROUNDS or turn > 0 and (work <= PAIRS_PER_POSTING * total or work > before / 2)
        before = work
        if last:
            known = measured.select(F.col("a").alias("leader"), F.col("b").alias("node"), "common")
            led = rest.join(leaders.select("key", F.col("leader.node").alias("leader")), "key").where("node != leader").join(known, ["leader", "node"], "left")
            prefix = rest.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
            pairs = block_pairs(led.join(prefix, "node"), open_keys, percent)
        else:
            # the leader is the node with the smallest share of its own, as an original has among its edited copies
            order = F.struct(F.col("own") / F.col("size"), "node") if turn == 0 else F.struct((F.col("own") / F.col("size") * 16).cast("int"), F.xxhash64("node", F.lit(turn)))
            chosen = rest.groupBy("key").agg(F.min_by(F.struct("node", "component", "size", "own"), order).alias("leader"))
            met = rest.join(chosen, "key").where("component != leader.component")
            met = met.select(*(F.col(f"leader.{c}").alias(f"a_{c}") for c in ("node", "size", "own")), *(F.col(c).alias(f"b_{c}") for c in ("node", "size", "own")))
            pairs = met.where(possible(percent)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
        pairs = _with_signatures(pairs, nodes).where(collisions("a_", "b_") >= least).select("a", "b")
        found = measure(pairs, shingles)
        if turn == 0:
            leaders, measured = chosen, checkpointed(found)
            found = measured
        found = found.where(similar(F.col("common"), percent)).select("a", "b")
        edges = checkpointed(found if edges is None else edges.unionByName(found))
        if last:
            break
        lists = postings.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return edges if edges is not None else postings.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, tie: bool = True) -> DataFrame:
    """id, text_hash, n_shingles, and first_id and first_hash, the smallest (id, text_hash) of the class, a row for each row.

    With ``tie`` the texts of one id are in one class; without, every text is on its own. Nodes are numbered in the order
    of the smallest (id, text_hash) that has their set and the numbers written, so the smallest node of a component
    leads to the first text of the class.
    """
    signed = checkpointed(signatures(docs, key, text, width))
    usable = signed.where("n_shingles > 0 AND id IS NOT NULL")
    sets_of = usable.groupBy("d0", "d1").agg(F.min(F.struct("id", "text_hash")).alias("of"), *(F.min(c).alias(c) for c in _LANES))
    nodes = checkpointed(sets_of.select("d0", "d1", "of.*", *_LANES).orderBy("id", "text_hash", "d0", "d1").withColumn("node", F.monotonically_increasing_id()))
    edges = link(docs, nodes, width, percent, key, text)
    if tie:
        several = usable.groupBy("id").agg(F.min(F.struct("d0", "d1")).alias("low"), F.max(F.struct("d0", "d1")).alias("high")).where("low != high").select("id")
        tied = usable.join(several, "id").select("id", "d0", "d1").distinct().join(nodes.select("d0", "d1", "node"), ["d0", "d1"])
        edges = edges.unionByName(tied.join(tied.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")))
    labels = connected_components(edges)
    first = F.struct("id", "text_hash")
    roots = labels.select("component").distinct().join(nodes.select(F.col("node").alias("component"), first.alias("root")), "component")
    named = nodes.select("d0", "d1", "node", first.alias("own")).join(salted(labels, roots, "component", "node").select("node", "root"), "node", "left")
    out = signed.select("id", "text_hash", "n_shingles", "d0", "d1").join(named.select("d0", "d1", F.coalesce("root", "own").alias("first")), ["d0", "d1"], "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("first", first))
    return out.select("id", "text_hash", "n_shingles", found["id"].alias("first_id"), found["text_hash"].alias("first_hash"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the smallest id of the class) and kept (whether it is that one), a row for each row."""
    found = classes(docs, key, text, width, percent).select("id", "n_shingles", F.col("first_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose text is the first of its class, by id and then hash, one row for each id and text.

    Texts without words and rows with a null id are in no class; of those with an id one row for each text stays too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)  # so that no name clashes
    key, text = (names[docs.columns.index(c)] for c in (key, text))
    found = classes(rows, key, text, width, percent, tie=False).where("id = first_id AND text_hash = first_hash").select("id", "text_hash").distinct()
    hashed = rows.withColumn("text_hash", F.xxhash64(text))
    staying = hashed.join(found, (hashed[key] == found["id"]) & (hashed["text_hash"] == found["text_hash"]), "left_semi").dropDuplicates([key, "text_hash"])
    return staying.select(*names).unionByName(rows.where(F.col(key).isNull())).toDF(*docs.columns)
