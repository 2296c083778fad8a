"""Plans that the library should get from Spark: pushed filters, pruned columns, no Python and no needless shuffles."""

from pyspark.sql import functions as F

from harrier.functions.urls import normalize_url, url_parts
from harrier.operators.html_features import html_features
from harrier.operators.url_features import WordLists, url_features
from harrier.plans import sweeps
from harrier.queries import policy


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_features_are_native_and_shuffle_free(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = url_features(url_parts(pages.select("page_id", normalize_url("url").alias("url"))), WordLists(["a"], ["b"]))
    for df in (urls, html_features(pages)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert "html" not in plan(urls).split("ReadSchema: ")[1].split("\n")[0]


def test_cascade_prunes_columns_and_pushes_filters(spark, sf):
    done = policy.probabilities(spark, sf).where(F.col("l_partkey") > 100).select("l_orderkey", "p_url")
    text = plan(done)
    assert "GreaterThan(l_partkey,100)" in text
    assert "l_shipdate" not in text and "l_suppkey" not in text.split("ReadSchema: ")[1].split("\n")[0]


def test_sweeps_meet_histograms_not_rows(spark, sf):
    p = policy.probabilities(spark, sf)
    values = sweeps.margins(51)
    rows, cells = p.count(), sweeps.histogram(p, policy.P, "y", values).count()
    text = plan(sweeps.margin_sweep(p, policy.P, "y", values))
    assert cells < rows
    assert "BroadcastNestedLoopJoin" in text and "Python" not in text
