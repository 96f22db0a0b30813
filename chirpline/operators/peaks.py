"""Minimum and maximum envelopes at any zoom, on grids anchored at time zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.functions.scales import js_round


def decimated(samples: DataFrame, target: float) -> DataFrame:
    """(source_id, channel, k, low, high): at most ``target`` blocks of each signal.

    Block k of a signal of len samples and out blocks begins at floor(k * (len / out)).
    A sample's block is found by arithmetic from its number, corrected by at most one
    for rounding; samples beyond the last edge belong to none.
    """
    sizes = samples.groupBy("source_id", "channel").agg((F.max("n") + 1).alias("len"))
    wanted = max(1, math.floor(target + 0.5))
    sized = samples.join(sizes, ["source_id", "channel"]).withColumn("out", F.least(F.col("len"), F.lit(wanted)))
    step = F.col("len") / F.col("out")
    edge = lambda k: F.floor(k * step)
    guess = F.floor(F.col("n") / step)
    k = F.when(edge(guess) > F.col("n"), guess - 1).when(edge(guess + 1) <= F.col("n"), guess + 1).otherwise(guess)
    return sized.withColumn("k", k).where("k >= 0 and k < out").groupBy("source_id", "channel", "k").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def bucket_of(n: Column, step: float, rate: float) -> Column:
    """The bucket k whose samples [round(k * step * rate), round((k + 1) * step * rate)) hold n."""
    edge = lambda k: js_round(k * step * rate)
    guess = F.floor(n / (step * rate))
    return F.when(edge(guess) > n, guess - 1).when(edge(guess + 1) <= n, guess + 1).otherwise(guess)


def _bucketed(samples: DataFrame, step: float, rate: float, first: int, last: int) -> DataFrame:
    low, high = math.floor(first * step * rate + 0.5), math.floor((last + 1) * step * rate + 0.5)
    inside = samples.where((F.col("n") >= low) & (F.col("n") < high))
    return inside.groupBy("source_id", "channel", bucket_of(F.col("n"), step, rate).alias("k")).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def envelope(samples: DataFrame, start: float, end: float, width: int, rate: float) -> DataFrame:
    """(source_id, channel, k, t_center, x_px, low, high) for pixels of a viewport.

    The grid of buckets is absolute, so panning keeps each bucket's values.
    """
    dt = (end - start) / width
    first, last = max(0, math.floor((start - dt) / dt)), math.ceil((end + dt) / dt)
    centre = (F.col("k") + 0.5) * dt
    return _bucketed(samples, dt, rate, first, last).select("source_id", "channel", "k", centre.alias("t_center"), ((centre - start) / (end - start) * width).alias("x_px"), "low", "high")


def line(samples: DataFrame, start: float, end: float, width: int, rate: float, sizes: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, n, x_px, y) of every sample of a viewport and one beyond each end,
    for zooms with at most one sample a pixel. A range that reaches the end of a signal has
    one more point, at which the last sample is repeated.

    That point needs the lengths (source_id, channel, n_samples) of the signals; with them, as
    ``signals.lengths`` takes from chunks, no sample outside the viewport is looked at.
    """
    low, high = math.floor(start * rate) - 1, math.ceil(end * rate) + 1
    inside = samples.where(F.col("n").between(low, high)).select("source_id", "channel", "n", "x")
    if sizes is None:
        sizes = samples.groupBy("source_id", "channel").agg((F.max("n") + 1).alias("n_samples"))
    ends = sizes.where(F.col("n_samples").between(low, high)).select("source_id", "channel", (F.col("n_samples") - 1).alias("n"))
    last = inside.join(ends, ["source_id", "channel", "n"]).select("source_id", "channel", (F.col("n") + 1).alias("n"), "x")
    # the last sample of a range that begins right behind it lies outside
    behind = samples.where(F.col("n") == low - 1).join(ends, ["source_id", "channel", "n"]).select("source_id", "channel", (F.col("n") + 1).alias("n"), "x")
    points = inside.unionByName(last).unionByName(behind)
    return points.select("source_id", "channel", "n", ((F.col("n") / rate - start) / (end - start) * width).alias("x_px"), F.col("x").alias("y"))


def bars(samples: DataFrame, start: float, end: float, seconds: float, rate: float) -> DataFrame:
    """(source_id, channel, k, low, high) of bars of fixed duration around a viewport."""
    first = max(0, math.floor((start - seconds) / seconds))
    return _bucketed(samples, seconds, rate, first, math.ceil((end + seconds) / seconds))


def bar_seconds(span: float, width: float, bar_px: float, gap_px: float, ratio: float = 1.0) -> float:
    """Duration of a bar of a width and gap in CSS pixels."""
    return span * max(1.0, (bar_px + gap_px) * ratio) / max(1.0, width)


def bar_geometry(low: Column, high: Column, height: float, align: str = "center", symmetric: bool = True, width_px: float = 3.0, least: float = 2.0) -> tuple[Column, Column, Column]:
    """(top, bottom, height) of a bar in pixels."""
    peak = F.greatest(F.abs(low), F.abs(high))
    if align in ("top", "bottom"):
        tall = F.greatest(F.lit(least), peak * height)
        top, bottom = (F.lit(0.0), tall) if align == "top" else (height - tall, F.lit(float(height)))
    else:
        half, cap = height / 2, width_px / 2
        up = F.greatest(F.lit(max(cap, least / 2)), peak * half) if symmetric else F.greatest(F.lit(cap), high * half)
        down = up if symmetric else F.greatest(F.lit(cap), F.abs(low) * half)
        top, bottom = half - up, half + down
    return top, bottom, F.greatest(F.lit(least), bottom - top)


def visible(bars_px: DataFrame, width: float, bar_px: float) -> DataFrame:
    """Bars (x_px) that reach into the canvas."""
    return bars_px.where((F.col("x_px") + bar_px >= 0) & (F.col("x_px") <= width))


def rolled_up(level: DataFrame, factor: int) -> DataFrame:
    """The envelope of buckets ``factor`` times as long from a stored one, exactly where the
    edges of its buckets nest (whole numbers of samples)."""
    by = level.groupBy("source_id", "channel", F.floor(F.col("k") / factor).alias("k"))
    return by.agg(F.min("low").alias("low"), F.max("high").alias("high"))


def outline(values: Column, height: float, amplitude: float = 1.0) -> Column:
    """Height in pixels of a value in a waveform."""
    return height / 2 - values * (height / 2 * max(0.01, amplitude))
