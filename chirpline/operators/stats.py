"""Rolling, tumbling and summary statistics of durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(samples: DataFrame, rows: int = 60) -> DataFrame:
    """(source_id, n, low, high, mean) over the last ``rows`` samples.

    Samples are windowed in blocks with a halo of earlier ones, so a long signal is
    spread over tasks.
    """
    block = 4096
    own = F.floor(F.col("n") / block)
    sent = samples.withColumn("block", F.explode(F.when(F.col("n") % block >= block - rows + 1, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("source_id", "block").orderBy("n").rowsBetween(-(rows - 1), 0)
    out = sent.select("source_id", "n", "block", F.min("x").over(last).alias("low"), F.max("x").over(last).alias("high"), F.avg("x").over(last).alias("mean"))
    return out.where(F.floor(F.col("n") / block) == F.col("block")).drop("block")


def tumbling(samples: DataFrame, rows: int = 30) -> DataFrame:
    """(source_id, k, low, high, mean, rate) of each full run of ``rows`` samples; rate is
    their number per second of summed milliseconds."""
    by = samples.groupBy("source_id", F.floor(F.col("n") / rows).alias("k"))
    full = by.agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean")).where(F.col("m") == rows)
    return full.select("source_id", "k", "low", "high", "mean", (1000 / F.col("mean")).alias("rate"))


#: Quantiles of a source that cut its values into buckets.
CUTS = 64


def at_ranks(samples: DataFrame, sizes: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """(source_id, name, ...): for each name the value at a zero-based rank, an expression of
    ``count``.

    Values lie in buckets between approximate quantiles of their own source, so buckets are
    about as large however narrow the values lie; equal values are counted together first. The
    counts of lower buckets are added up, and only the buckets that hold a rank are sorted.
    """
    counted = samples.groupBy("source_id", "x").agg(F.count(F.lit(1)).alias("c"))
    cuts = samples.groupBy("source_id").agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 2000).alias("cuts"))
    wide = 8
    passed = lambda at: F.coalesce((F.get("cuts", at) <= F.col("x")).cast("int"), F.lit(0))
    dealt = counted.join(cuts, "source_id").withColumn("step", sum((passed(F.lit(wide * k - 1)) for k in range(1, CUTS // wide)), F.lit(0)) * wide)
    dealt = dealt.withColumn("bucket", sum((passed(F.col("step") + k) for k in range(wide)), F.col("step"))).select("source_id", "bucket", "x", "c")
    buckets = dealt.groupBy("source_id", "bucket").agg(F.sum("c").alias("m"))
    below = F.sum("m").over(Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = buckets.withColumn("below", F.coalesce(below, F.lit(0))).join(sizes.select("source_id", "count"), "source_id").select("*", *[r.alias(n) for n, r in ranks.items()])
    holds = F.lit(False)
    for n in ranks:
        holds = holds | F.col(n).between(F.col("below"), F.col("below") + F.col("m") - 1)
    inside = dealt.join(placed.where(holds), ["source_id", "bucket"])
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("source_id", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto)
    found = [F.max(F.when(F.col(n).between(F.col("upto") - F.col("c"), F.col("upto") - 1), F.col("x"))).alias(n) for n in ranks]
    return ranked.groupBy("source_id").agg(*found)


def summary(samples: DataFrame) -> DataFrame:
    """(source_id, count, mean, median, std, low, high, p95): population deviation; p95 is the
    element at floor(0.95 * count) of the sorted values."""
    sizes = samples.groupBy("source_id").agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    n = F.col("count")
    ranks = {"mid0": F.floor((n - 1) / 2), "mid1": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95))}
    return sizes.join(at_ranks(samples, sizes, ranks), "source_id").withColumn("median", (F.col("mid0") + F.col("mid1")) / 2).drop("mid0", "mid1")
