"""Exact quantiles of groups of any size, by brackets that sketches narrow.

A sketch of fixed size places a wanted rank between two of its cuts. The next pass counts what lies below, at and between these
and sketches only what is between, so each pass leaves about a hundredth, whatever the distribution. A value that
makes up much of a group becomes a cut and leaves the bracket. Once few values are left they are sorted. No
pass holds the values of a group; what is kept between passes has one row for each group and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.sources.store import shared_folder

#: Cuts of a sketch; its error in rank is far below the share between two cuts.
CUTS, ACCURACY = 256, 10_000
#: So many values of a group, or of a group between two cuts, are sorted in one task in place of sketched (2 MB).
FEW = 250_000


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*(F.lit(i / CUTS) for i in range(CUTS + 1))), F.lit(ACCURACY))


def _ranks(n: Column, quantiles: Sequence[float]) -> Column:
    """The places, from 0, of the values that each quantile lies between."""
    both = [f(F.lit(float(q)) * (n - 1)) for q in quantiles for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*both))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], few: int = FEW) -> DataFrame:
    """k0, k1, ... (the keys), n, rank and the value at it, for the ranks from 0 that the quantiles lie between."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{k}`").alias(c) for k, c in zip(keys, names, strict=True)), F.col(f"`{value}`").cast("double").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))  # -0.0 is 0.0
    start = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    shared_folder(df.sparkSession)
    start = start.withColumn("ranks", _ranks(F.col("n"), quantiles)).checkpoint()
    short = start.where(F.col("n") <= few).select(*(F.col(c).alias(f"b{c}") for c in names), "n", "ranks")
    same = [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in names]
    sorted_ = (rows.join(short, same) if names else rows.crossJoin(F.broadcast(short))).groupBy(*names, "n", "ranks").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    done = sorted_.select(*names, "n", F.explode("ranks").alias("rank"), "vs").select(*names, "n", "rank", F.get("vs", F.col("rank").cast("int")).alias("value"))
    open_ = start.where(F.col("n") > few).select(*names, "n", F.explode("ranks").alias("rank"), "lo", "hi")
    while not open_.isEmpty():
        bounds = open_.select(*(F.col(c).alias(f"b{c}") for c in names), "n", "rank", "lo", "hi")
        on = [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in names] 
        within = rows.join(bounds, on) if names else rows.crossJoin(F.broadcast(bounds))  # without keys: one group's few ranks
        inside = (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))
        counts = within.groupBy(*(F.col(f"b{c}").alias(c) for c in names), "n", "rank", "lo", "hi").agg(
            F.count_if(F.col("v") < F.col("lo")).alias("below"),
            F.count_if(F.col("v") == F.col("lo")).alias("at_lo"),
            F.count_if(inside).alias("inside"),
            _sketch(F.when(inside, F.col("v"))).alias("cuts"),
        )
        place = F.col("rank") - F.col("below") - F.col("at_lo")
        i = F.floor(place * CUTS / F.greatest("inside", F.lit(1))).cast("int")
        found = F.when(place < 0, F.col("lo")).when(place >= F.col("inside"), F.col("hi"))
        narrowed = counts.withColumns({"place": place, "found": found, "i": i})
        narrowed = narrowed.withColumns({
            "small": F.col("found").isNull() & (F.col("inside") <= few),
            "next_lo": F.when(F.col("found").isNull() & (F.col("i") >= 1), F.try_element_at("cuts", F.col("i"))).otherwise(F.col("lo")),
            "next_hi": F.coalesce(F.when(F.col("found").isNull() & (F.col("i") + 3 <= CUTS + 1), F.try_element_at("cuts", F.col("i") + 3)), F.col("hi")),
        })
        narrowed = narrowed.drop("cuts").checkpoint()
        settled = narrowed.where("found IS NOT NULL").select(*names, "n", "rank", F.col("found").alias("value"))
        small = narrowed.where("small").select(*(F.col(c).alias(f"b{c}") for c in names), "n", "rank", "lo", "hi", "place")
        left = rows.join(small, on) if names else rows.crossJoin(F.broadcast(small))
        few_values = left.where(inside).groupBy(*(F.col(f"b{c}").alias(c) for c in names), "n", "rank", "place").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most ``few`` values
        sorted_ = few_values.select(*names, "n", "rank", F.get("vs", F.col("place").cast("int")).alias("value"))
        done = done.unionByName(settled).unionByName(sorted_)
        open_ = narrowed.where("found IS NULL AND NOT small").select(*names, "n", "rank", F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi"))
    return done


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """The keys and a column for each wanted quantile, linear between neighbouring values. Nulls and NaN aren't counted; groups without values are left out."""
    names = [f"k{i}" for i in range(len(keys))]
    found = ranked_values(df, keys, value, list(wanted.values()), few)
    table = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"), F.max("n").alias("n"))  # two ranks a quantile

    def one(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        share = place - F.floor(place)
        # rounded once, as SQL engines do it: sums of rounded products differ from them at ties of a later round()
        between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1.0 - share, high * share).cast("double")
        return F.when(low == high, low).otherwise(between)

    return table.select(*(F.col(c).alias(k) for c, k in zip(names, keys, strict=True)), *(one(q).alias(name) for name, q in wanted.items()))
