"""Incremental ingestion as a stream: landed feed files are read once and merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrier.sources.store import merge_urls, upsert_urls


def landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def ingest(events: DataFrame, table: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Merges each batch into versions of the table under ``table``: version=<batch id>, the highest one being current.

    A batch writes a version of its own from the version before it, so a batch that is repeated after a failure
    overwrites what it had begun and nothing else.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = upsert_urls(batch, key)
        before = [b for b in range(batch_id) if _exists(spark, f"{table}/version={b}/_SUCCESS")]
        merged = merge_urls(spark.read.parquet(f"{table}/version={before[-1]}"), changes, key) if before else changes
        merged.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest version."""
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


def latency_windows(events: DataFrame, at: str, keys: list[str], ms: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean times by window and key; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"))
