"""Learning samples of a bounded size, chosen by the hash of an id so that they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; the split of learning and held-out rows (null key: 0)."""
    return F.coalesce(F.crc32(key.cast("string")) % F.lit(modulus), F.lit(0).cast("long"))


def sampled_rows(docs: DataFrame, chosen: DataFrame, key: str, limit: int, *columns: str) -> DataFrame:
    """Rows of ``docs`` whose key is among at most ``limit`` keys of ``chosen`` (key and further columns, one row a key).

    The keys with the smallest hashes are taken. They are at most ``limit`` rows of a few bytes, so they are
    broadcast, and the other texts stay where they are read. Of the rows of a repeated key the smallest is taken, so
    there are at most ``limit`` rows.
    """
    keys = chosen.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), F.col(key)).limit(limit)
    found = docs.select(key, *columns).join(F.broadcast(keys), key)
    names = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min(F.struct(*names)).alias("__row")).select(key, "__row.*")
