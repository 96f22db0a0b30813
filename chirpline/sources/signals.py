"""Signals from tables: numbered samples, stored chunks, range reads and clips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in a stored chunk.
CHUNK = 4096


def ordered_signal(rows: DataFrame, source: Column, order: list[str], value: Column, period: Column) -> DataFrame:
    """(source_id, channel, n, x): rows of each source numbered by ``order``.

    ``period`` is a coarse, monotonic function of the first order column (such as its
    day). Rows are numbered inside each period, and the counts of earlier periods, one
    small row for each, are added, so a long signal is never sorted in one task.
    """
    keyed = rows.select(source.cast("string").alias("source_id"), period.alias("period"), *order, value.cast("double").alias("x"))
    counts = keyed.groupBy("source_id", "period").agg(F.count(F.lit(1)).alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("source_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source_id", "period", F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("source_id", "period").orderBy(*order)) - 1
    numbered = keyed.withColumn("i", inside).join(offsets, ["source_id", "period"])
    return numbered.select("source_id", F.lit(0).alias("channel"), (F.col("i") + F.col("offset")).alias("n"), "x")


def array_signals(rows: DataFrame, source: Column, values: Column) -> DataFrame:
    """(source_id, channel, n0, x): one chunk for each array."""
    return rows.select(source.cast("string").alias("source_id"), F.lit(0).alias("channel"), F.lit(0).cast("long").alias("n0"), values.cast("array<double>").alias("x"))


def chunked(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(source_id, channel, n0, x) from single samples; no group exceeds ``size``."""
    by = samples.groupBy("source_id", "channel", (F.floor(F.col("n") / size) * size).alias("n0"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))


def exploded(chunks: DataFrame) -> DataFrame:
    """Single samples from chunks."""
    return chunks.select("source_id", "channel", "n0", F.posexplode("x").alias("i", "x")).select("source_id", "channel", (F.col("n0") + F.col("i")).alias("n"), "x")


def sample_range(start: float, end: float, rate: float) -> tuple[int, int]:
    """Samples [a, b) of a time range; near-integers snap."""
    import math

    return max(0, math.floor(start * rate + 1e-6)), max(0, math.ceil(end * rate - 1e-6))


def read_range(chunks: DataFrame, start: float, end: float, rate: float, channel: int = 0) -> DataFrame:
    """The chunks of a time range, cut to it; chunks outside are pruned by n0."""
    a, b = sample_range(start, end, rate)
    hit = chunks.where((F.col("channel") == channel) & (F.col("n0") < b) & (F.col("n0") + F.size("x") > a))
    first = F.greatest(F.col("n0"), F.lit(a))
    last = F.least(F.col("n0") + F.size("x"), F.lit(b))
    cut = F.slice("x", (first - F.col("n0") + 1).cast("int"), (last - first).cast("int"))
    return hit.select("source_id", "channel", first.alias("n0"), cut.alias("x"))


def clipped(chunks: DataFrame, start: float, end: float, rate: float) -> DataFrame:
    """Chunks with zeros outside the clip; lengths stay those of the parent."""
    a, b = sample_range(start, end, rate)
    n = lambda i: F.col("n0") + i
    return chunks.withColumn("x", F.transform("x", lambda v, i: F.when((n(i) >= a) & (n(i) < b), v).otherwise(F.lit(0.0))))


@dataclass(frozen=True)
class Clip:
    """A clip and the chunks that it was cut from; a clip of a clip is cut from the same."""

    source: DataFrame
    start: float
    end: float
    rate: float

    def clip(self, start: float, end: float) -> Clip:
        return Clip(self.source, start, end, self.rate)

    def chunks(self) -> DataFrame:
        return clipped(self.source, self.start, self.end, self.rate)


def lengths(chunks: DataFrame) -> DataFrame:
    """(source_id, channel, n_samples)."""
    return chunks.groupBy("source_id", "channel").agg(F.max(F.col("n0") + F.size("x")).alias("n_samples"))


def events_signal(events: DataFrame) -> DataFrame:
    """One signal for each event type: values by time, numbered day by day."""
    return ordered_signal(events, F.col("event_type"), ["ts", "event_id"], F.col("value"), F.to_date("ts"))
