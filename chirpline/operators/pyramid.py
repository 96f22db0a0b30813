"""Envelopes of any ranges from stored levels of minima and maxima."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.functions.scales import js_round
from chirpline.sources.signals import lengths

NODE = "source_id string, channel int, node long, low double, high double, level int"


def _each(low: Column, high: Column, make: Callable[[Column], Column]) -> Column:
    """An array of what is made of low, low + 1, ... high - 1."""
    return F.when(low < high, F.transform(F.sequence(low, high - 1), make))


def _node_of(level: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(level).alias("level"), i.alias("node"))


def _floor_by(size: int) -> Callable[[Column], Column]:
    return lambda n: F.floor(n / size)


class Pyramid:
    """Levels of nodes below a folder: a node of level L holds the least and greatest of
    ``base`` * ``fan`` ** L samples, and those of each level are made from the level below.

    A range is cut into whole nodes, at most 2 * (fan - 1) of a level, and two ends of fewer
    than ``base`` samples, which are read from the chunks. Its edges may lie anywhere.
    """

    def __init__(self, spark: SparkSession, path: str, base: int = 64, fan: int = 8):
        if base < 1 or fan < 2:
            raise ValueError("base must be positive and fan at least 2")
        self.spark, self.path, self.base, self.fan = spark, path, base, fan

    def build(self, chunks: DataFrame) -> int:
        """Write the chunks, cut at multiples of ``base``, and all levels; how many there are."""
        base = self.base
        first, last = F.floor(F.col("n0") / base), F.floor((F.col("n0") + F.size("x") - 1) / base)
        pieces = chunks.where(F.size("x") > 0).withColumn("node", F.explode(F.sequence(first, last)))
        low = F.greatest(F.col("node") * base, F.col("n0"))
        high = F.least((F.col("node") + 1) * base, F.col("n0") + F.size("x"))
        cut = F.slice("x", (low - F.col("n0") + 1).cast("int"), (high - low).cast("int"))
        by = pieces.groupBy("source_id", "channel", "node").agg(F.array_sort(F.collect_list(F.struct(low.alias("n"), cut.alias("x")))).alias("p"))
        raw = by.select("source_id", "channel", "node", F.flatten(F.transform("p", lambda s: s["x"])).alias("x"))
        raw.sortWithinPartitions("source_id", "channel", "node").write.parquet(f"{self.path}/raw")
        longest = lengths(chunks).agg(F.max("n_samples")).first()[0] or 0
        leaf = self.raw().select("source_id", "channel", "node", F.array_min("x").alias("low"), F.array_max("x").alias("high"))
        leaf.write.parquet(f"{self.path}/levels/level=0")
        levels = 1
        while base * self.fan**levels < longest:
            below = self._level(levels - 1)
            above = below.groupBy("source_id", "channel", F.floor(F.col("node") / self.fan).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
            above.write.parquet(f"{self.path}/levels/level={levels}")
            levels += 1
        return levels

    def raw(self) -> DataFrame:
        return self.spark.read.schema("source_id string, channel int, node long, x array<double>").parquet(f"{self.path}/raw")

    def _level(self, level: int) -> DataFrame:
        return self.spark.read.schema(NODE.removesuffix(", level int")).parquet(f"{self.path}/levels/level={level}")

    def nodes(self) -> DataFrame:
        """(source_id, channel, node, low, high, level) of all levels, a folder each."""
        return self.spark.read.schema(NODE).parquet(f"{self.path}/levels")

    def parts(self, a: Column, b: Column, levels: int) -> tuple[Column, Column]:
        """What [a, b) is cut into: (level, node) of whole nodes, and (start, end) of raw ends."""
        inner = [(F.ceil(a / size) * size, F.floor(b / size) * size) for size in (self.base * self.fan**k for k in range(levels))]
        nodes = []
        for k, (low, high) in enumerate(inner):
            node, place = _node_of(k), _floor_by(self.base * self.fan**k)
            if k + 1 == levels:
                nodes.append(_each(place(low), place(high), node))
                continue
            above_low, above_high = inner[k + 1]
            split = above_low < above_high
            nodes.append(_each(place(low), F.when(split, place(above_low)).otherwise(place(high)), node))
            nodes.append(F.when(split, _each(place(above_high), place(high), node)))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        low, high = inner[0]
        ends = F.when(low < high, F.array(F.struct(a.alias("start"), low.alias("end")), F.struct(high.alias("start"), b.alias("end"))))
        # a range without a whole node may still lie in two of them
        middle = F.least(b, (F.floor(a / self.base) + 1) * self.base)
        ends = F.coalesce(ends, F.array(F.struct(a.alias("start"), middle.alias("end")), F.struct(middle.alias("start"), b.alias("end"))))
        return F.flatten(F.array(*[F.coalesce(n, none) for n in nodes])), F.filter(ends, lambda e: e["start"] < e["end"])

    def extremes(self, ranges: DataFrame, levels: int) -> DataFrame:
        """``ranges`` (source_id, channel, a, b, ...) with low and high of their samples; ranges
        without samples go. Two equality joins: with the nodes, and with the chunks of the ends."""
        keys = ranges.columns
        nodes, ends = self.parts(F.col("a"), F.col("b"), levels)
        whole = ranges.select("*", F.explode(nodes).alias("__n")).select(*keys, "__n.level", "__n.node").join(self.nodes(), ["source_id", "channel", "level", "node"]).select(*keys, "low", "high")
        asked = ranges.select("*", F.explode(ends).alias("__e")).select(*keys, "__e.start", "__e.end", F.floor(F.col("__e.start") / self.base).alias("node"))
        cut = F.slice("x", (F.col("start") - F.col("node") * self.base + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        at_ends = asked.join(self.raw(), ["source_id", "channel", "node"]).select(*keys, cut.alias("x")).select(*keys, F.array_min("x").alias("low"), F.array_max("x").alias("high"))
        both = reduce(DataFrame.unionByName, (whole, at_ends)).where("low is not null")
        return both.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def bucket_ranges(sizes: DataFrame, start: float, end: float, width: int, rate: float) -> DataFrame:
    """(source_id, channel, k, a, b): samples [a, b) of each pixel's bucket of a viewport, on the
    absolute grid of ``peaks.envelope``, for signals (source_id, channel, n_samples)."""
    import math

    dt = (end - start) / width
    first, last = max(0, math.floor((start - dt) / dt)), math.ceil((end + dt) / dt)
    rows = sizes.select("source_id", "channel", "n_samples", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("k"))
    edge = lambda k: js_round(k * dt * rate)
    return rows.select("source_id", "channel", "k", edge(F.col("k")).cast("long").alias("a"), F.least(edge(F.col("k") + 1).cast("long"), F.col("n_samples")).alias("b")).where("a < b")
