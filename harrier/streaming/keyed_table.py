"""A keyed table under a stream: rows in buckets by the hash of their key, copied on write, behind a manifest.

A batch reads the live files of the buckets that its keys fall into, merges, and writes those buckets anew; the others stay
as they are. Then it writes a manifest, which names the live folder of every bucket, and so commits. A batch that fails
before that leaves the table as it was; a batch whose manifest is there already changes nothing. The ``keep`` newest
manifests can be read; what only older ones name is deleted.

The driver handles bucket numbers and folder names, whose number is the parameter ``buckets``, and no rows. Rows with a null
key can't be merged and are left out. Choose so many buckets that one is a task's work; one key that has a third of a
batch's rows is reduced before it meets the table, by the partial aggregation of ``upsert``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrier.sources.store import merge_urls, upsert_urls

Upsert = Callable[[DataFrame, str], DataFrame]
Merge = Callable[[DataFrame, DataFrame, str], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "url", buckets: int = 256, keep: int = 2, upsert: Upsert = upsert_urls, merge: Merge = merge_urls):
        """upsert reduces a batch to one row a key; merge brings stored rows up to date by such rows."""
        if keep < 1:
            raise ValueError("at least the newest version is kept")
        self.spark, self.path, self.key, self.buckets, self.keep, self.upsert, self.merge_rows = spark, path, key, buckets, keep, upsert, merge

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        files, folder = self._files(), self._path("manifest")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and files.exists(self._path(f"manifest/{n}/_SUCCESS")))

    def manifest(self, version: int) -> dict[int, str]:
        """The live folder of each bucket that has rows."""
        return {r["bucket"]: r["folder"] for r in self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default."""
        known = self.versions()
        if not known:
            raise ValueError(f"nothing has been written to {self.path}")
        live = self.manifest(known[-1] if version is None else version)
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in sorted(live.values())))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Merges a batch, once whatever happens; gives the buckets that were written anew."""
        known = self.versions()
        if known and known[-1] >= batch_id:
            return []
        live = self.manifest(known[-1]) if known else {}
        spark = batch.sparkSession  # of a stream's batch, another one than the table's
        changes = self.upsert(batch.where(F.col(self.key).isNotNull()), self.key).persist()
        try:
            touched = sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())
            folder = f"data/batch={batch_id}"
            if touched:
                old = [f"{self.path}/{live[b]}" for b in touched if b in live]
                rows = self.merge_rows(spark.read.parquet(*old), changes, self.key) if old else changes
                # a bucket is one task's work and one file
                rows = rows.withColumn("bucket", self.bucket()).repartition("bucket")
                rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
            live |= {b: f"{folder}/bucket={b}" for b in touched}
            self.spark.createDataFrame(sorted(live.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={batch_id}")
        finally:
            changes.unpersist()
        self._clean()
        return touched

    def _clean(self) -> None:
        known = self.versions()
        kept, old = known[-self.keep :], known[: -self.keep]
        live = {f for v in kept for f in self.manifest(v).values()}
        files = self._files()
        for version in old:
            for folder in set(self.manifest(version).values()) - live:
                files.delete(self._path(folder), True)
            files.delete(self._path(f"manifest/version={version}"), True)

    def ingest(self, events: DataFrame, checkpoint: str, at: str = "ts", order: str = "seq", late: str = "1 day", once: bool = True) -> StreamingQuery:
        """Merges a stream, batch by batch. Events that come again (key, time and order) are dropped while no more than ``late``
        behind the newest; what comes later than that is dropped with them."""
        fresh = events.withWatermark(at, late).dropDuplicatesWithinWatermark([self.key, at, order])
        out = fresh.writeStream.foreachBatch(lambda batch, batch_id: self.apply(batch, batch_id) and None).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out).start()
