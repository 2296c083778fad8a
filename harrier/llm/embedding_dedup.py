"""Embedding near-dedup by NN-descent over a graph that starts in hyperplane buckets, and exact comparison of families.

Vectors of one label are compared by cosine in double precision; pairs at ``least`` or more are links. Vectors
that are null, empty or zero, hold a null or non-finite component, or have a null label or id link with nothing.

1. *Balls.* Equal and very close vectors are set aside first: tables of ``BALL_BITS`` random hyperplane signs put
   close vectors together, and a vector within half the link angle of a table's smallest id joins that ball. By the
   triangle inequality all members of a ball are linked with each other, so they are counted, not paired, and only
   the ball's centre takes part in the descent. A third of all vectors may be copies of one.
2. *Start.* A few tables of hyperplane signs put centres into buckets of about ``8 * GROUP``: as many as leave a pair at
   ``least`` without a common bucket with a chance below ``MISS``. Vectors of a bucket are compared in blocks of
   ``BLOCK`` against blocks, and each centre starts with the ``NEIGHBOURS`` nearest ones it met, however far they are.
3. *Descent.* In each round the centres of a list, the one whose list it is, and those that list it (in groups of
   ``GROUP``) are compared with each other, and lists are made anew of all that was found, both ways, until no link and
   hardly any entry is new. The rounds find the links that the start has left out.
4. *Enlarging.* A list that holds links only is saturated and grows up to ``ENLARGED`` times its length. As it would grow
   on to the size of its group, its ball goes to the family of the smallest centre that it is linked with, so that a
   dense group is one family rather than a list for each of its members. Pairs of families with a link are found.
5. *Links.* The members of such a pair, and of one family, are compared exactly, in blocks against blocks, and counted;
   no task holds a whole family. Members of one ball aren't compared. Pairs at the threshold stay.
6. *Audit.* The links of ``AUDITED`` vectors are compared with brute force, and of as many again until ``PAIRS`` links have
   been seen or ``AUDITS`` rounds are over; with a recall below ``RECALL`` all is done again from a start in more tables
   (``MISS`` to its third power, at most twice), and a last recall below ``WANTED`` is an error.

Rows of one id are one vector (the smallest by content). Results have one row for each input row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.components import checkpointed, connected_components

LEAST = 0.93
#: The length of a list, the links of a vector from which its ball goes to a family, and how much longer a list of links may get.
NEIGHBOURS, ENLARGED = 10, 4
#: Rounds end when no link and no more than this share of the entries of all lists is new.
SETTLED = 0.02
#: Vectors audited at a time, the links that make an audit, how often vectors are added, the recall that ends the search and the least.
AUDITED, PAIRS, AUDITS, RECALL, WANTED = 512, 1000, 4, 0.999, 0.98
#: Buckets hold about 8 * GROUP centres; a pair of the least similarity shares none with a chance below MISS.
GROUP = 48
MISS = 0.05
#: The search for pairs of families asks for so much less than a link.
SLACK = 1e-9
BALL_TABLES, BALL_BITS = 8, 20
BLOCK = 512


def _matrix(packed: pa.Array | pd.Series) -> np.ndarray:
    """Unit vectors in double precision, from packed ones."""
    return np.stack([np.frombuffer(x if isinstance(x, bytes) else x.as_py(), dtype=np.float64) for x in packed]) if len(packed) else np.zeros((0, 1))


def _planes(dims: int, bits: int, table: int) -> np.ndarray:
    return np.random.default_rng([dims, bits, table]).normal(size=(dims, bits))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """From (id, label, embedding): id, label and the packed unit vector of each usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            keep, packed = [], []
            for i, v in enumerate(vectors):
                x = np.array(v.as_py(), dtype=np.float64) if v.is_valid else np.zeros(0)  # a null component becomes NaN
                size = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(size) and size > 0:
                    x = x / size
                    keep.append(i)
                    packed.append((x / np.sqrt(x @ x)).tobytes())
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(packed, type=pa.binary())], names=["id", "label", "vector"])

    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long"), F.col("label").cast("string"), "embedding")
    return usable.mapInArrow(run, "id long, label string, vector binary").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", F.concat("v.label", F.lit("|"), F.octet_length("v.vector").cast("string")).alias("label"), "v.vector")


def coded(vectors: DataFrame, bits: str | int, tables: int, first: int = 0) -> DataFrame:
    """id, label and code, a row for each table: the table's number and the signs of ``bits`` (a number or column) projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(3).to_pylist(), dtype=np.int64)
            lengths = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                x = _matrix([batch.column(2)[int(i)].as_py() for i in at])
                for table in range(first, first + tables):
                    signs = (x @ _planes(int(dims), 24, table) > 0).astype(np.int64)
                    weights = np.where(np.arange(24) < sizes[at][:, None], np.int64(1) << np.arange(24), 0)
                    code = (signs * weights).sum(axis=1) + (np.int64(table) << 32)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(code)], names=["id", "label", "code"])

    return vectors.select("id", "label", "vector", F.lit(bits).cast("int").alias("bits") if isinstance(bits, int) else F.col(bits).cast("int").alias("bits")).mapInArrow(run, "id long, label string, code long")


def balls(vectors: DataFrame, least: float) -> DataFrame:
    """id, centre and the angle to it, for every vector; a vector in no ball is its own centre."""
    half = np.arccos(least) / 2 - 1e-9
    codes = coded(vectors, BALL_BITS, BALL_TABLES)
    leaders = codes.groupBy("label", "code").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = codes.join(leaders, ["label", "code"]).where("id != centre").select("id", "centre").distinct()
    near = angles(pairs, vectors).where(F.col("angle") <= half)
    best = near.groupBy("id").agg(F.min(F.struct("centre", "angle")).alias("b")).select("id", "b.centre", "b.angle")
    # a centre that has joined another ball gives up its own members
    lasting = best.join(best.select(F.col("id").alias("centre")), "centre", "left_anti")
    return vectors.select("id").join(lasting, "id", "left").select("id", F.coalesce("centre", "id").alias("centre"), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def angles(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The angle between the vectors of each (id, centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                cosine = np.array([np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer()) for x, y in zip(part.column(2), part.column(3), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["id", "centre", "angle"])

    both = pairs.join(vectors.select("id", F.col("vector").alias("x")), "id").join(vectors.select(F.col("id").alias("centre"), F.col("vector").alias("y")), "centre")
    return both.select("id", "centre", "x", "y").mapInArrow(run, "id long, centre long, angle double")


def blocked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (id, centre, owner, salt and the key ``by``) with the number of their block within the key.

    Members of a ball of more than ``BLOCK`` share blocks with each other only; ``owner`` is that ball, or null.
    """
    parts = rows.where("owner IS NULL").groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    small = rows.where("owner IS NULL").join(parts, by).withColumn("block", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    return small.unionByName(rows.where("owner IS NOT NULL").withColumn("block", F.xxhash64("owner", "salt")))


def met(rows: DataFrame, pairs: DataFrame | None, by: list[str], vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows of units of two blocks (unit, side, id and what ``vectors`` holds of it, dealt over tasks t), and their number.

    Blocks meet within a key or, with ``pairs`` (a, b) of keys, across each pair. Two blocks of one ball don't meet.
    """
    numbered = checkpointed(blocked(rows, by))
    blocks = numbered.groupBy(*by, "block", "owner").agg(F.count("*").alias("n")).drop("n")
    one = blocks.select(*(F.col(c).alias(f"{c}_i") for c in (*by, "block", "owner")))
    two = blocks.select(*(F.col(c).alias(f"{c}_j") for c in (*by, "block", "owner")))
    if pairs is None:
        both = one.join(two, [one[f"{c}_i"] == two[f"{c}_j"] for c in by])
    else:
        both = pairs.join(one, F.col("a") == one[f"{by[0]}_i"]).join(two, F.col("b") == two[f"{by[0]}_j"])
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_i") == F.col(f"{c}_j") for c in by])
    other = ~F.coalesce(F.col("owner_i") == F.col("owner_j"), F.lit(False))
    units = both.where(other & (~same | (F.col("block_i") <= F.col("block_j"))))
    units = checkpointed(units.withColumn("unit", F.xxhash64(*(f"{c}_{s}" for s in "ij" for c in (*by, "block")))).withColumn("twice", ~same | (F.col("block_i") != F.col("block_j"))))
    sides = [(0, "i", units), (1, "j", units.where("twice"))]
    found = [numbered.join(u.select("unit", *(F.col(f"{c}_{s}").alias(c) for c in (*by, "block"))), [*by, "block"]).select("unit", F.lit(side).alias("side"), "id") for side, s, u in sides]
    n = max(1, units.count() // 16)
    return reduce(DataFrame.unionByName, found).join(vectors, "id").withColumn("t", F.pmod("unit", F.lit(n))), n


def bucketed(distinct: DataFrame, least: float, miss: float) -> DataFrame:
    """Rows with their buckets (label, code), one for each of the label's tables.

    A table has ``bits`` hyperplane signs, so that a bucket holds about ``8 * GROUP`` centres, and the tables of a label
    are as many as it takes for a pair at ``least`` to share no bucket with a chance below ``miss``, whatever its size.
    """
    sizes = distinct.groupBy("label").agg(F.count_distinct("centre").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("n") / (8 * GROUP))))).cast("int")
    share = F.pow(F.lit(1 - float(np.arccos(least)) / np.pi), F.col("bits"))
    tables = F.when(F.col("bits") == 0, 1).otherwise(F.ceil(F.log(F.lit(miss)) / F.log(1 - share))).cast("int")
    sized = distinct.join(F.broadcast(sizes.select("label", bits.alias("bits")).withColumn("tables", tables)), "label")
    schema = distinct.select("id", "centre", "owner", "salt", "label").schema.add("code", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, tables = (np.array(batch.column(k).to_pylist(), dtype=np.int64) for k in (6, 7))
            lengths = np.array([len(x.as_buffer()) // 8 for x in batch.column(5)])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                x = _matrix([batch.column(5)[int(i)].as_py() for i in at])
                for table in range(int(tables[at].max())):
                    use = tables[at] > table
                    signs = x[use] @ _planes(int(dims), 24, 100 + table) > 0
                    weights = np.where(np.arange(24) < bits[at[use]][:, None], np.int64(1) << np.arange(24), 0)
                    take = pa.array(at[use])
                    code = pa.array((signs * weights).sum(axis=1) + (np.int64(table) << 32))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(5)), code], names=schema.names)

    return sized.select("id", "centre", "owner", "salt", "label", "vector", "bits", "tables").mapInArrow(run, schema)


def _sides(unit: pd.DataFrame, least: float) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """The two blocks of a unit and which rows of different balls are linked."""
    x, y = unit[unit["side"] == 0], unit[unit["side"] == 1]
    y = y if len(y) else x
    hit = _matrix(x["vector"]) @ _matrix(y["vector"]).T >= least
    return x, y, hit & (x["centre"].to_numpy()[:, None] != y["centre"].to_numpy()[None, :])


def families(units: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(centre, family): a ball with ``NEIGHBOURS`` links or more in a unit or its list goes to the family of the smallest linked centre."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in rows.groupby("unit", sort=False):
            x, y, hit = _sides(unit, least)
            for a, b, h in ((x, y, hit), (y, x, hit.T)):
                at = np.flatnonzero(h.any(axis=1))
                others = np.where(h[at], b["centre"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1) if len(at) else []
                out += list(zip(a["centre"].to_numpy()[at], others, h[at].sum(axis=1), strict=True))
        return pd.DataFrame(out, columns=["centre", "other", "n"]).astype("int64")

    listed = lists.where(F.col("cosine") >= least).groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("other"), F.count("*").alias("n"))
    found = units.groupBy("t").applyInPandas(run, "centre long, other long, n long").unionByName(listed)
    found = found.groupBy("centre").agg(F.min("other").alias("other"), F.max("n").alias("n"))
    return found.select("centre", F.when(F.col("n") >= NEIGHBOURS, F.least("centre", "other")).otherwise(F.col("centre")).alias("family"))


def family_pairs(units: DataFrame, least: float) -> DataFrame:
    """The distinct (a, b), a <= b, of families with a link between two of their balls that share a bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for _, unit in rows.groupby("unit", sort=False):
            x, y, hit = _sides(unit, least)
            i, j = np.nonzero(hit)
            p, q = x["family"].to_numpy()[i], y["family"].to_numpy()[j]
            pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
            out |= set(map(tuple, pairs.tolist()))
        return pd.DataFrame(list(out), columns=["a", "b"]).astype("int64")

    return units.groupBy("t").applyInPandas(run, "a long, b long").distinct()


def member_links(units: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) links of vectors with those of other balls, and (a, b) of balls, edges that join the same balls as all links do.

    A unit gives one edge for each ball that it links, so the edges of a group don't grow with the square of its size.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in rows.groupby("unit", sort=False):
            x, y, hit = _sides(unit, least)
            if not hit.any():
                continue
            own = x is y
            counts = [(x, hit.sum(axis=1))] if own else [(x, hit.sum(axis=1)), (y, hit.sum(axis=0))]
            top = np.iinfo(np.int64).max
            left, right = x["centre"].to_numpy().copy(), y["centre"].to_numpy().copy()
            while True:  # the smallest centre that the links lead to
                up = np.minimum(left, np.where(hit, right[None, :], top).min(axis=1))
                down = np.minimum(right, np.where(hit, up[:, None], top).min(axis=0))
                if (up == left).all() and (down == right).all():
                    break
                left, right = up, down
            for (side, n), root in zip(counts, (left, right), strict=False):
                out += [(int(c), int(r), int(i), int(k)) for c, r, i, k in zip(side["centre"], root, side["id"], n, strict=True) if k]
        return pd.DataFrame(out, columns=["a", "b", "id", "n"]).astype("int64")

    links = checkpointed(units.groupBy("t").applyInPandas(run, "a long, b long, id long, n long"))
    return links.groupBy("id").agg(F.sum("n").alias("n")), links.select("a", "b").distinct()


PAIR = "a long, b long, cosine double"


def nearest(pairs: DataFrame, least: float) -> DataFrame:
    """The ``NEIGHBOURS`` nearest b of each a, from pairs in either direction; of links ``ENLARGED`` times as many."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    limit = F.when(F.col("cosine") >= least, ENLARGED * NEIGHBOURS).otherwise(NEIGHBOURS)
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def started(units: DataFrame, least: float) -> DataFrame:
    """The nearest centres of each one that share a bucket with it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in rows.groupby("unit", sort=False):
            x, y, other_ball = _sides(unit, -2.0)
            cosine = np.where(other_ball, _matrix(x["vector"]) @ _matrix(y["vector"]).T, -2)
            p, q = x["centre"].to_numpy(), y["centre"].to_numpy()
            for own, other, c in ((p, q, cosine), (q, p, cosine.T)):
                best = np.argpartition(-c, min(NEIGHBOURS, c.shape[1]) - 1, axis=1)[:, :NEIGHBOURS]
                i, j = np.nonzero(np.take_along_axis(c, best, axis=1) > -2)
                out.append(np.rec.fromarrays([own[i], other[best[i, j]], c[i, best[i, j]]], names="a,b,cosine"))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros(0, dtype=[("a", "i8"), ("b", "i8"), ("cosine", "f8")]))

    return nearest(units.groupBy("t").applyInPandas(run, PAIR), least)


def descend(lists: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """The lists after a round in which the members of each list, its owner, and those that list the owner meet.

    Whoever lists one owner is dealt over groups of about ``GROUP``, so a centre in very many lists makes no large group.
    A pair leaves its task only if it can enter one of its two lists, as the last entry of each list tells.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby(["owner", "part"], sort=False):
            ids, x = group["id"].to_numpy(), _matrix(group["vector"])
            cosine = x @ x.T
            np.fill_diagonal(cosine, -2)
            best = np.argpartition(-cosine, min(NEIGHBOURS, len(ids)) - 1, axis=1)[:, :NEIGHBOURS]
            kept = cosine >= least
            np.put_along_axis(kept, best, True, axis=1)
            kept &= cosine >= group["last"].to_numpy()[:, None]
            i, j = np.nonzero(np.triu(kept | kept.T, 1))
            out.append(np.rec.fromarrays([ids[i], ids[j], cosine[i, j]], names="a,b,cosine"))
        return pd.DataFrame(np.concatenate(out)).drop_duplicates(["a", "b"])

    parts = lists.groupBy(F.col("b").alias("owner")).agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    listing = lists.select(F.col("b").alias("owner"), F.col("a").alias("id")).join(parts, "owner").select("owner", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id")
    own = lists.select(F.col("a").alias("owner"), F.lit(0).cast("long").alias("part"), F.explode(F.array("a", "b")).alias("id"))
    members = listing.unionByName(own).distinct()
    n = max(1, lists.count() // 2048)
    size, low = F.count("*"), F.min("cosine")
    last = F.when(size < NEIGHBOURS, -2.0).when((low >= least) & (size < ENLARGED * NEIGHBOURS), least).otherwise(low)
    lasts = lists.groupBy(F.col("a").alias("id")).agg(last.alias("last"))
    met = members.join(centres, "id").join(lasts, "id").withColumn("t", F.pmod(F.xxhash64("owner", "part"), F.lit(n)))
    return nearest(met.groupBy("t").applyInPandas(run, PAIR).unionByName(lists), least)


def neighbour_lists(units: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): the lists after rounds of descent until they have settled."""
    lists = checkpointed(started(units, least))
    while not lists.isEmpty():
        after = checkpointed(descend(lists, centres, least))
        new = after.join(lists.select("a", "b"), ["a", "b"], "left_anti").agg(F.count("*").alias("n"), F.count_if(F.col("cosine") >= least).alias("links")).first()
        lists = after
        if new["links"] == 0 and new["n"] <= SETTLED * lists.count():
            break
    return lists


def audited(member: DataFrame, each: DataFrame, least: float) -> tuple[float, int]:
    """The mean recall of the links (id, n_links) of sampled vectors that have any, and how many links those have."""
    shares, seen = [], 0
    for turn in range(AUDITS):
        order = F.xxhash64("id", F.lit(77))
        sample = member.select("id", "label", "vector").orderBy(order, "id").offset(turn * AUDITED).limit(AUDITED).collect()
        if not sample:
            break
        by_label: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for label in {r["label"] for r in sample}:
            own = [r for r in sample if r["label"] == label]
            by_label[label] = np.array([r["id"] for r in own]), _matrix([bytes(r["vector"]) for r in own])
        shared = member.sparkSession.sparkContext.broadcast(by_label)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = np.array(batch.column(1).to_pylist(), dtype=object)
                for label in set(labels.tolist()) & set(shared.value):
                    at = np.flatnonzero(labels == label)
                    ids, x = shared.value[label]
                    y = _matrix([batch.column(2)[int(i)].as_py() for i in at])
                    hit = (x @ y.T >= least) & (ids[:, None] != batch.column(0).to_numpy()[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(axis=1))], names=["id", "n"])

        true = member.select("id", "label", "vector").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
        for r in true.join(each, "id").select("n", "n_links").collect():  # at most AUDITED rows
            shares.append(min(r["n_links"] / r["n"], 1.0))
            seen += r["n"]
        if seen >= PAIRS:
            break
    return (float(np.mean(shares)) if shares else 1.0), seen


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """id, n_links, component_id and kept, a row for each row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    unit = checkpointed(unit_vectors(rows))
    ball = checkpointed(balls(unit, least))
    groups = ball.groupBy("centre").agg(F.count("*").alias("size"))
    big = groups.where(F.col("size") > BLOCK).select("centre", F.col("centre").alias("owner"), F.ceil(F.col("size") / BLOCK).alias("parts"))
    member = checkpointed(ball.join(unit, "id").join(big, "centre", "left").select("id", "centre", "label", "vector", "owner", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0).cast("long")).alias("salt")))
    miss = MISS
    while True:
        each = checkpointed(_linked(member, ball, least, miss))
        recall, _ = audited(member, each, least)
        if recall >= RECALL:
            break
        if miss < MISS**8:
            if recall < WANTED:
                raise RuntimeError(f"{recall:.3f} of the links of the audited vectors were found")
            break
        miss **= 3
    out = rows.select("id").join(each, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _linked(member: DataFrame, ball: DataFrame, least: float, miss: float) -> DataFrame:
    """id, n_links and component_id of each vector in ``member`` (id, centre, label, vector, owner, salt)."""
    vectors = member.select("id", "centre", "vector")
    # equal vectors of a ball have the same buckets, so one of them stands for all in the search
    codes = bucketed(member.groupBy("label", "centre", "vector").agg(F.min(F.struct("id", "owner", "salt")).alias("m")).select("label", "centre", "vector", "m.*"), least, miss)
    near, _ = met(codes, None, ["label", "code"], vectors)
    lists = neighbour_lists(near, member.where("id = centre").select("id", "vector"), least - SLACK)
    family = checkpointed(families(near, lists, least - SLACK))
    graph = lists.where(F.col("cosine") >= least - SLACK).select("a", "b")
    named = vectors.join(family, "centre", "left").withColumn("family", F.coalesce("family", "centre"))
    near = near.join(family, "centre", "left").withColumn("family", F.coalesce("family", "centre"))
    of = {c: family.select(F.col("centre").alias(c), F.col("family").alias(f"{c}_family")) for c in "ab"}
    ends = [F.coalesce("a_family", "a"), F.coalesce("b_family", "b")]
    refined = graph.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    pairs = checkpointed(family_pairs(near, least - SLACK).unionByName(refined).distinct())
    rows_of = member.select("id", "centre", "owner", "salt").join(named.select("id", "family"), "id")
    rows_of = rows_of.join(pairs.select(F.explode(F.array("a", "b")).alias("family")).distinct(), "family", "left_semi")
    units, _ = met(rows_of, pairs, ["family"], vectors)
    across, linked = member_links(units, least)
    # components of centres, each named by the smallest member of its balls
    of_centre = connected_components(linked)
    smallest = ball.groupBy("centre").agg(F.min("id").alias("smallest"), F.count("*").alias("n"))
    named = smallest.join(of_centre.withColumnRenamed("node", "centre"), "centre", "left").withColumn("component", F.coalesce("component", "centre"))
    component = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    info = named.join(component, "component").select("centre", "component_id", F.col("n").alias("together"))
    return ball.join(info, "centre").join(across, "id", "left").select("id", (F.col("together") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")
