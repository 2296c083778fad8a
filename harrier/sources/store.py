"""Keyed upserts and collection state over plain tables: results are new tables, for the caller to write."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("phish", "benign")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; a temporary one where there is none, on one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def upsert_urls(events: DataFrame, key: str = "url", at: str = "ts", label: str = "label", source: str = "source", order: str = "seq") -> DataFrame:
    """One row a key: created_at of the first event, updated_at of the last, label and source of the last event with either.

    Label and source are set together, so the one that is missing in that event becomes null. Events of equal time are
    told apart by ``order``.
    """
    when = F.struct(F.col(at), F.col(order))
    given = (F.coalesce(F.col(label), F.lit("")) != "") | (F.coalesce(F.col(source), F.lit("")) != "")
    both = F.struct(F.nullif(F.col(label), F.lit("")).alias("label"), F.nullif(F.col(source), F.lit("")).alias("source"))
    out = events.groupBy(key).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max(F.when(given, F.struct(when.alias("w"), both.alias("b")))).alias("__b"))
    return out.select(key, "created_at", "updated_at", F.col("__b.b.label").alias("label"), F.col("__b.b.source").alias("source"))


def merge_urls(stored: DataFrame, changes: DataFrame, key: str = "url") -> DataFrame:
    """An upserted table brought up to date by another: insert-only columns of the first, last writes of the second."""
    old, new = stored.alias("o"), changes.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col("n.label").isNotNull() | F.col("n.source").isNotNull()
    return joined.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key),
        F.least("o.created_at", "n.created_at").alias("created_at"),
        F.greatest("o.updated_at", "n.updated_at").alias("updated_at"),
        F.when(fresh, F.col("n.label")).otherwise(F.col("o.label")).alias("label"),
        F.when(fresh, F.col("n.source")).otherwise(F.col("o.source")).alias("source"),
    )


def snapshot_key(domain: Column, at: Column) -> Column:
    return F.concat_ws("|", domain, F.date_format(at, "yyyy-MM-dd"))


def snapshots(records: DataFrame, domain: str = "domain", at: str = "collected_at", order: str = "seq") -> DataFrame:
    """The last record of each domain and day, under its key."""
    keyed = records.withColumn("snapshot", snapshot_key(F.col(domain), F.col(at)))
    others = [c for c in keyed.columns if c != "snapshot"]
    return keyed.groupBy("snapshot").agg(F.max_by(F.struct(*others), F.struct(at, order)).alias("__r")).select("snapshot", "__r.*")


def latest_reference(records: DataFrame, url: str, domain: str = "domain", at: str = "collected_at", order: str = "seq") -> DataFrame:
    """For each URL the key of its newest snapshot."""
    return records.groupBy(url).agg(F.max_by(snapshot_key(F.col(domain), F.col(at)), F.struct(at, order)).alias("record_ref"))


def as_of_snapshot(urls: DataFrame, records: DataFrame, domain: str = "domain", at: str = "at", collected: str = "collected_at", piece: str = "month") -> DataFrame:
    """Each URL row with the newest snapshot of its domain that isn't later than the URL's own time; unmatched rows stay.

    Both sides are laid in the order of time and the last record carried on, so nothing is paired. A domain is dealt in
    pieces of its time (as ``date_trunc`` names them), each of which begins with the last record of the pieces before,
    so a busy domain isn't one task's. Of snapshots of equal time the largest record counts.
    """
    url = F.struct(*(F.col(f"`{c}`") for c in urls.columns))
    record = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    none = lambda df: F.lit(None).cast(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("x")).schema["x"].dataType)
    cut = lambda c: F.date_trunc(piece, F.col(c))
    snaps = records.select(F.col(domain).alias("d"), cut(collected).alias("piece"), F.col(collected).alias("t"), F.lit(0).alias("side"), none(urls).alias("url"), record.alias("record"))
    rows = urls.select(F.col(domain).alias("d"), cut(at).alias("piece"), F.col(at).alias("t"), F.lit(1).alias("side"), url.alias("url"), none(records).alias("record"))
    both = snaps.unionByName(rows)
    newest = both.groupBy("d", "piece").agg(F.max(F.when(F.col("side") == 0, F.struct("t", "record"))).alias("newest"))
    before = Window.partitionBy("d").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select("d", "piece", F.last("newest.record", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("d", "piece").orderBy("t", "side", "record").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("last", F.last("record", ignorenulls=True).over(so_far)).where("side = 1")
    out = met.join(carried, met["d"].eqNullSafe(carried["d"]) & met["piece"].eqNullSafe(carried["piece"]), "left")
    known = met["d"].isNotNull() & F.col("t").isNotNull()
    return out.select("url.*", F.when(known, F.coalesce("last", "carried")).alias("record"))


def store_content(urls: DataFrame, contents: DataFrame, key: str = "url", at: str = "ts", content: str = "content") -> DataFrame:
    """The URL table with the newest content of each key and its time; a key that isn't there yet comes in without a label."""
    newest = contents.groupBy(key).agg(F.max_by(F.struct(F.col(content).alias("content"), F.col(at).alias("content_at")), F.struct(at, content)).alias("__c"), F.min(at).alias("__first"))
    joined = urls.drop("content", "content_at").join(newest, key, "full")
    kept = [F.col(c) for c in urls.columns if c not in (key, "content", "content_at", "created_at", "updated_at")]
    return joined.select(key, F.coalesce("created_at", "__first").alias("created_at"), F.greatest("updated_at", "__c.content_at").alias("updated_at"), *kept, F.col("__c.content").alias("content"), F.col("__c.content_at").alias("content_at"))


def attempt_totals(attempts: DataFrame, error: str = "error", steps: tuple[str, ...] = ("domain", "content")) -> DataFrame:
    """Counters of a run in which each row fails for itself: attempts, stored (no error at all) and those whose step went well."""
    failed = lambda s: F.col(f"{s}_{error}").isNotNull()
    none = ~reduce(lambda a, b: a | b, map(failed, steps))
    return attempts.agg(F.count("*").alias("attempts"), F.count_if(none).alias("stored"), *(F.count_if(~failed(s)).alias(f"{s}_ok") for s in steps))


def cached(df: DataFrame, folder: str, name: str, refresh: bool = False) -> DataFrame:
    """df as it was written under its name in a shared folder, or written there now; ``refresh`` writes it anew."""
    path = f"{folder}/{name}"
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_run(df: DataFrame, path: str, keys: tuple[str, ...] = ("seed", "fold")) -> None:
    """The results of runs, in place of those of the same keys and of no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """A table of results as CSV with a header; nested columns as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}).write.mode("overwrite").csv(path, header=True)


def labelled(urls: DataFrame, require: str | None = None, label: str = "label") -> DataFrame:
    """Rows with a known label and, if asked, with something in the required column."""
    out = urls.where(F.col(label).isin(*LABELS))
    return out if require is None else out.where(F.col(require).isNotNull())


def count_labelled(urls: DataFrame, require: str | None = None, limit: int | None = None, label: str = "label") -> DataFrame:
    n = F.count("*") if limit is None else F.least(F.count("*"), F.lit(limit).cast("long"))
    return labelled(urls, require, label).agg(n.alias("n"))


def with_records(urls: DataFrame, records: DataFrame, ref: str = "record_ref", key: str = "snapshot", limit: int | None = None, order: str = "url") -> DataFrame:
    """Labelled URLs with the record they refer to, or null. The limit takes the first by ``order``, before the join."""
    rows = urls if limit is None else urls.orderBy(order).limit(limit)
    named = records.dropDuplicates([key]).select(F.col(key).alias("__k"), F.struct(*records.columns).alias("record"))
    return rows.join(named, F.col(ref) == F.col("__k"), "left").drop("__k")


def any_positive(df: DataFrame, group: str, label: str, order: str, usable: Column | None = None) -> DataFrame:
    """One row a group: positive if any row is, with the columns of the first usable row. Rows without a group stay apart."""
    ok = F.lit(True) if usable is None else usable
    grouped = df.where(F.col(group).isNotNull()).groupBy(group)
    first = F.min(F.when(ok, F.struct(F.col(order).alias("o"), F.struct(*df.columns).alias("r")))).alias("__f")
    rows = grouped.agg(F.bool_or(F.col(label) == LABELS[0]).alias("positive"), first).where("__f IS NOT NULL").select("__f.r.*", "positive")
    alone = df.where(F.col(group).isNull() & ok).withColumn("positive", F.coalesce(F.col(label) == LABELS[0], F.lit(False)))
    return rows.unionByName(alone)


def since(feed: DataFrame, last_run: DataFrame, source: str, at: str = "verified_at") -> DataFrame:
    """Rows at or after the source's last run, and rows without a time; all of them if it has never run."""
    mark = last_run.where(F.col("source") == source).agg(F.max("last_run_at").alias("__m"))  # one row
    return feed.join(F.broadcast(mark)).where(F.col("__m").isNull() | F.col(at).isNull() | (F.col(at) >= F.col("__m"))).drop("__m")


def advance(state: DataFrame, source: str, started: Column) -> DataFrame:
    """The state with the source's mark moved to the start of a run that has succeeded."""
    own = state.sparkSession.range(1).select(F.lit(source).alias("source"), started.alias("last_run_at"))
    return state.select("source", "last_run_at").unionByName(own).groupBy("source").agg(F.max("last_run_at").alias("last_run_at"))


def pending(terms: DataFrame, done: DataFrame, key: str = "term") -> DataFrame:
    """Terms that aren't done yet."""
    return terms.join(done.select(key), key, "left_anti")
