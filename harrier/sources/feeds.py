"""Readers of URL feeds and lists. Live fetching is left to collectors outside Spark; these read what they landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments that a log without a key is cut into.
SEGMENTS = 256


def parse_time(text: Column) -> Column:
    """An ISO 8601 time, in UTC if it names no zone; null if it is none."""
    return F.try_to_timestamp(F.trim(text))


def in_file_order(df: DataFrame) -> DataFrame:
    """df with ``ordinal``, which rises in the order of the rows within and across the files."""
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def keep_first(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """The first row of each key."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(order, *(c for c in others if c != order))).alias("__r")).select(key, "__r.*").select(*df.columns)


def recent(feed: DataFrame, cutoff: Column | None, limit: int | None = None, url: str = "url", at: str = "verification_time", order: str = "ordinal") -> DataFrame:
    """Trimmed URLs that are new enough or have no readable time, in feed order; the limit counts kept rows."""
    rows = feed.withColumn(url, F.trim(url)).where(F.col(url) != "").withColumn("verified_at", parse_time(F.col(at)))
    if cutoff is not None:
        rows = rows.where(F.col("verified_at").isNull() | (F.col("verified_at") >= cutoff))
    return rows if limit is None else rows.orderBy(order).limit(limit)


def verified_only(feed: DataFrame) -> DataFrame:
    """Rows that are online and verified."""
    yes = lambda c: F.lower(F.trim(F.col(c))) == "yes"
    return feed.where(yes("online") & yes("verified"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return in_file_order(spark.read.csv(path, header=True))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a list of ``rank,domain`` or ``domain`` lines, with their ordinal."""
    lines = in_file_order(spark.read.text(path))
    domain = F.trim(F.regexp_replace(F.trim("value"), "^[^,]*,", ""))
    return lines.select("ordinal", domain.alias("domain")).where("domain <> ''")


def sample_domains(domains: DataFrame, n: int, seed: int, key: str = "domain") -> DataFrame:
    """min(n, all) domains without replacement, chosen by a seeded hash so that a rerun gives the same ones."""
    return domains.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def benign_urls(domains: DataFrame, key: str = "domain") -> DataFrame:
    return domains.select(F.concat(F.lit("https://"), F.col(key)).alias("url"), F.lit("benign").alias("label"))


def read_terms(spark: SparkSession, path: str, column: str = "Trends") -> DataFrame:
    """Distinct terms of a file with a header, in order."""
    rows = spark.read.csv(path, header=True)
    named = {c.lstrip("﻿"): c for c in rows.columns}
    if column not in named:
        raise ValueError(f"{path} has no column {column}")
    terms = in_file_order(rows.select(F.trim(F.col(f"`{named[column]}`")).alias("term"))).where("term <> ''")
    return terms.groupBy("term").agg(F.min("ordinal").alias("ordinal"))


def result_url(df: DataFrame) -> Column:
    """The first of href, url and link that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("href", "url", "link") if c in df.columns))


def until_failures(log: DataFrame, ok: Column, n: int, order: str = "seq", by: str | None = None) -> DataFrame:
    """The log up to and with the n-th failure in a row; later rows are left out.

    ``by`` names independent runs (one window each); without it the log is one run, which ``first_streak`` cuts into
    segments if ``order`` is a number, a date or a time.
    """
    if not by and isinstance(log.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        stop = F.broadcast(first_streak(log, ok, n, order))  # one row
        return log.join(stop).where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")
    part = [by] if by else []
    runs = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    streak = log.withColumn("__good", F.count_if(ok).over(runs)).withColumn("__ok", ok)
    failures = Window.partitionBy(*part, "__good").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = streak.withColumn("__streak", F.count_if(~F.col("__ok")).over(failures))
    stops = counted.groupBy(*part).agg(F.min(F.when(F.col("__streak") >= n, F.col(order))).alias("__stop"))
    met = counted.join(stops, by) if by else counted.join(F.broadcast(stops))
    return met.where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__good", "__ok", "__streak", "__stop")


def first_streak(log: DataFrame, ok: Column, n: int, order: str = "seq", segments: int = SEGMENTS) -> DataFrame:
    """One row, ``__stop``: where the log, as one run, has its n-th failure in a row, or null.

    The log is cut at quantiles of ``order``. A segment is summed up by its rows, by whether any went well and by the
    failures at its end; from these few rows each segment gets the failures that run into it, and then finds its own
    first stop by itself. Rows of one order stay together, those of a null order come
    first; a row whose ``ok`` is null neither fails nor ends a streak.
    """
    cuts = log.agg(F.percentile_approx(order, [i / segments for i in range(1, segments)]).alias("__cuts"))
    rows = log.select(F.col(order).alias("__o"), ok.alias("__ok")).join(F.broadcast(cuts))
    rows = rows.select("__o", "__ok", F.when(F.col("__o").isNull() | F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__o")))).alias("__s"))
    # a segment's last good row parts the failures at its end from the rest; rows of one order count by it as a whole
    last_ok = F.max(F.when(F.col("__ok"), F.struct("__o"))).alias("good")
    each = rows.groupBy("__s").agg(last_ok)
    ends = rows.join(F.broadcast(each), "__s").groupBy("__s").agg(  # a row for each segment
        F.count_if(F.col("good").isNotNull()).alias("any"),
        F.count_if(~F.col("__ok") & (F.col("good").isNull() | (F.struct("__o") > F.col("good")))).alias("trail"),
    )
    before = Window.orderBy("__s")  # as many rows as there are segments
    shifted = ends.select("__s", F.lag("trail", 1, 0).over(before).alias("trail"), (F.lag("any", 1, 0).over(before) > 0).cast("int").alias("any"))
    shifted = shifted.withColumn("run", F.sum("any").over(before))
    carried = shifted.select("__s", F.sum("trail").over(Window.partitionBy("run").orderBy("__s")).alias("__carry"))
    upto = Window.partitionBy("__s").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    streak = rows.withColumn("__good", F.count_if("__ok").over(upto)).where(~F.col("__ok"))
    streak = streak.withColumn("__n", F.count("*").over(Window.partitionBy("__s", "__good").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)))
    reached = streak.join(F.broadcast(carried), "__s").where(F.col("__n") + F.when(F.col("__good") == 0, F.col("__carry")).otherwise(0) >= n)
    return reached.agg(F.min("__o").alias("__stop"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """URLs with labels from a CSV file (url[,label]) or from text lines, where # starts a comment; the first of equal URLs counts."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        url = "url" if "url" in rows.columns else rows.columns[0]
        label = F.col("label") if "label" in rows.columns else F.lit(None).cast("string")
        rows = rows.select(F.trim(F.col(f"`{url}`")).alias("url"), label.alias("label"))
    else:
        rows = spark.read.text(path).select(F.trim("value").alias("url"), F.lit(None).cast("string").alias("label")).where(~F.startswith("url", F.lit("#")))
    rows = in_file_order(rows.where("url <> ''").select("url", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("unknown")).alias("label")))
    return keep_first(rows, "url").select("url", "label", "ordinal")


def labelled_set(phish: DataFrame, benign: DataFrame) -> DataFrame:
    """Both lists of URLs, positives first; the first label of a URL wins."""
    both = phish.select("url", F.lit("phish").alias("label"), F.struct(F.lit(0).alias("list"), "ordinal").alias("ordinal"))
    both = both.unionByName(benign.select("url", F.lit("benign").alias("label"), F.struct(F.lit(1).alias("list"), "ordinal").alias("ordinal")))
    return keep_first(both, "url").select("url", "label")


def truncate_utf8(text: Column, size: int) -> Column:
    """The text cut to ``size`` bytes, without a last character that was cut apart."""
    data = F.encode(text, "UTF-8")
    tail = lambda k: F.conv(F.hex(F.substring(data, size + 1 - k, 1)), 16, 10).cast("int")  # noqa: E731  k bytes before the cut, 1-based
    continues = lambda b: b.between(128, 191)
    back = F.when(~continues(tail(0)), 0).when(~continues(tail(1)), 1).when(~continues(tail(2)), 2).otherwise(3)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.decode(F.substring(data, F.lit(1), F.lit(size) - back), "UTF-8"))


def event_date(events: Column, words: tuple[str, ...]) -> Column:
    """The date of the first event whose action has one of the words in it."""
    action = lambda e: F.lower(F.coalesce(e["eventAction"], F.lit("")))
    hit = lambda e: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(action(e), w))
    return parse_time(F.get(F.filter(events, hit), F.lit(0))["eventDate"])
