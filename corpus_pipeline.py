"""A training-data pipeline over ``documents``: quality, near-dedup, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Rows are carried whole beside what a stage computes, under numbered names, so extra columns of
any name pass through. Null ids are kept; null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm import byte_bpe, decontaminate, minhash_dedup, pii, quality_fm
from harrier.llm.components import shared_folder
from harrier.llm.queries import GOOD, RANKS, quality_labels


def _small_batches(spark: SparkSession) -> None:
    """Python workers get a thousand rows at a time at most, since whole rows pass through them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """docs with its columns renamed by their places, these names, and the new name of each."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, dict(zip(docs.columns, names, strict=True))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    _small_batches(spark)
    model = quality_fm.learn(docs, quality_labels(spark, sf_dir))
    rows, names, new = _numbered(docs)
    scored = quality_fm.score(rows, model, text=new["text"], n_chars=new["n_chars"], keep=names)
    return scored.where(F.col("score") >= GOOD).select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the first by id and text.

    Different texts under one id are judged each on its own; of equal ones one row stays.
    """
    return minhash_dedup.first_of_each(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is inside benchmark windows."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names, new = _numbered(docs)
    hits = decontaminate.find_hits(rows, benchmark, text=new["text"], keep=names)
    return hits.where(~decontaminate.contaminated()).select(*names).toDF(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date where the text changed."""
    found = pii.find(docs)
    changed = F.size("spans") > 0
    text = F.when(changed, pii.redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    out = found.select("row", text.alias("__text"), changed.alias("__changed"))
    columns = {"text": F.col("__text"), "n_chars": F.when(F.col("__changed"), F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return out.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), their number and digest, and whether they decode to the text."""
    _small_batches(spark)
    path = public_tokenizers.path(RANKS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = byte_bpe.encode(rows.withColumn("text_sha256", F.sha2("text", 256)), path, public_tokenizers.PATTERN, keep=("doc_id", "text_sha256"))
    both = byte_bpe.decode(ids, path, keep=("doc_id", "text_sha256", "ids"))
    return both.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("decodes"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("personal_data", redacted),
    ("byte_bpe", token_ids),
]
#: A trained classifier, a graph bootstrapped over rounds and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
