"""Unions of ranges and coverage tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Blocks of time that ranges are dealt to where the caller gives none.
BLOCKS = 64


def blocked(ranges: DataFrame, block: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``ranges`` with the block of each start: blocks hold about as many ranges each, however
    times crowd. The cuts are one row of the plan, so nothing runs before the result is asked for."""
    if block is not None:
        return ranges.withColumn("block", block)
    places = [k / blocks for k in range(1, blocks)]
    cuts = ranges.agg(F.percentile_approx("start", places, 10_000).alias("__cuts")).select(F.lit(1).alias("__one"), F.coalesce("__cuts", F.array().cast("array<double>")).alias("__cuts"))
    rows = ranges.withColumn("__one", F.lit(1)).join(F.broadcast(cuts), "__one")
    # how many cuts lie at or before the start, in steps and then one by one
    wide = math.isqrt(blocks)
    passed = lambda at: F.coalesce((F.get("__cuts", at) <= F.col("start")).cast("int"), F.lit(0))
    rows = rows.withColumn("__wide", sum((passed(F.lit(wide * k - 1)) for k in range(1, -(-blocks // wide))), F.lit(0)) * wide)
    return rows.withColumn("block", sum((passed(F.col("__wide") + k) for k in range(wide)), F.col("__wide"))).drop("__cuts", "__one", "__wide")


def merged(ranges: DataFrame, key: str, block: Column | None = None) -> DataFrame:
    """(key, start, end): touching and overlapping ranges of a key united; empty ones go.

    Ranges are united inside blocks of time first, in one exchange. What goes on to other
    tasks is a row for each block of a key: how far its ranges reach and where its last island
    begins. From those each block knows what reaches into it and which island that is, so no
    task sorts a key. ``block``, a monotonic function of start, may be given by the caller.
    """
    ranges = ranges.where("end > start").select(key, "start", "end")
    rows = blocked(ranges, block)
    inside = Window.partitionBy(key, "block").orderBy("start", "end")
    before = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.coalesce(F.col("start") <= before, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("local", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy(key, "block", "local").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    blocks = local.groupBy(key, "block").agg(F.max("end").alias("far"), F.max("start").alias("last"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reached = blocks.withColumn("reach", F.max("far").over(earlier))
    opened = F.when(F.col("reach").isNull() | (F.col("last") > F.col("reach")), F.col("last"))
    carried = reached.select(key, "block", "reach", F.last(opened, ignorenulls=True).over(earlier).alias("carried"))
    joined = local.join(carried, [key, "block"])
    island = F.when(F.col("start") <= F.col("reach"), F.col("carried")).otherwise(F.col("start"))
    return joined.groupBy(key, island.alias("island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covered(wanted: DataFrame, islands: DataFrame, key: str, block: Column | None = None) -> DataFrame:
    """``wanted`` (key, start, end) with covered: one island holds all of it.

    Islands don't overlap, so the last one that begins at or before a range decides. It is
    found by a sort of both sides within blocks of time, with the last island of earlier
    blocks carried in, rather than by comparing all pairs.
    """
    mark = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    both = islands.select(key, "start", "end", F.lit(0).alias("asked"), mark.alias("island")).unionByName(wanted.select(key, "start", "end", F.lit(1).alias("asked"), F.lit(None).cast("struct<s:double,e:double>").alias("island")))
    both = blocked(both, block)
    lasts = both.groupBy(key, "block").agg(F.max("island").alias("last"))
    carried = lasts.select(key, "block", F.max("last").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    seen = F.last("island", ignorenulls=True).over(Window.partitionBy(key, "block").orderBy("start", "asked").rowsBetween(Window.unboundedPreceding, 0))
    held = both.join(carried, [key, "block"]).withColumn("island", F.coalesce(seen, F.col("carried"))).where("asked = 1")
    return held.select(key, "start", "end", F.coalesce((F.col("end") <= F.col("start")) | (F.col("island.e") >= F.col("end")), F.lit(False)).alias("covered"))


def frontier(islands: DataFrame, key: str) -> DataFrame:
    """(key, frontier): how far the range from zero reaches without a gap."""
    return islands.groupBy(key).agg(F.max(F.when(F.col("start") <= 0, F.col("end")).otherwise(F.lit(0.0))).alias("frontier"))
