"""Spectrum, frame, point and pixel queries: many at once, as equi-joins on frame numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft, Viewport
from chirpline.functions.scales import array_in_mode, time_and_hz
from chirpline.plans.tiles import nearest_frame, total_frames
from chirpline.sources.signals import lengths


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("source_id", "channel").agg((F.max("frame_idx") + 1).alias("__total"))


def frame_sizes(chunks: DataFrame, cfg: Stft) -> DataFrame:
    """The same from the lengths of the signals, without their spectra."""
    return lengths(chunks).select("source_id", "channel", total_frames(F.col("n_samples"), cfg).alias("__total")).where("__total > 0")


def asked_frames(queries: DataFrame, sizes: DataFrame, rate: float, cfg: Stft) -> DataFrame:
    """Queries with the frame and the tile that they ask for. The tiles can be given to
    ``stft`` as those that are wanted, so that no others are computed."""
    asked = queries.join(sizes, ["source_id", "channel"])
    asked = asked.withColumn("frame_idx", nearest_frame(F.col("time"), rate, F.col("__total"), cfg)).drop("__total")
    return asked.withColumn("tile_idx", F.floor(F.col("frame_idx") / cfg.frames_per_tile))


def query_spectrum(queries: DataFrame, frames: DataFrame, rate: float, cfg: Stft, mode: str = "magnitude", sizes: DataFrame | None = None) -> DataFrame:
    """Each query (source_id, channel, time, ...) with the nearest frame's values.

    The frame number follows from the time, so the join is on equality. frame_idx counts
    from the start of the signal, tile_frame_idx from that of its tile. A signal without
    frames answers nothing. Without ``sizes`` frames are computed a second time to count them.
    """
    asked = asked_frames(queries, frame_counts(frames) if sizes is None else sizes, rate, cfg).drop("tile_idx")
    found = asked.join(frames.select("source_id", "channel", "frame_idx", array_in_mode(F.col("mag"), mode).alias("values")), ["source_id", "channel", "frame_idx"])
    return found.withColumn("tile_frame_idx", F.col("frame_idx") % cfg.frames_per_tile)


def query_frame(frames: DataFrame, frame_idx: int, mode: str = "magnitude") -> DataFrame:
    return frames.where(F.col("frame_idx") == frame_idx).select("source_id", "channel", "frame_idx", array_in_mode(F.col("mag"), mode).alias("values"))


def nearest_bin(hz: Column, rate: float, cfg: Stft) -> Column:
    """The nearest bin, the lower of two."""
    return F.greatest(F.lit(0), F.least(F.lit(cfg.bins - 1), F.ceil(hz * cfg.fft_size / rate - 0.5))).cast("int")


def query_point(queries: DataFrame, frames: DataFrame, rate: float, cfg: Stft, mode: str = "magnitude", sizes: DataFrame | None = None) -> DataFrame:
    """Each query (source_id, channel, time, frequency, ...) with frame, bin and value."""
    found = query_spectrum(queries, frames, rate, cfg, mode, sizes).withColumn("bin", nearest_bin(F.col("frequency"), rate, cfg))
    return found.withColumn("value", F.get("values", F.col("bin"))).drop("values")


def query_pixel(queries: DataFrame, frames: DataFrame, rate: float, cfg: Stft, view: Viewport, width: int, height: int, scale: str = "linear", mode: str = "magnitude", sizes: DataFrame | None = None) -> DataFrame:
    """Each query (source_id, channel, x, y, ...) by the pixel's time and frequency."""
    t, hz = time_and_hz(F.col("x"), F.col("y"), width, height, view, scale)
    return query_point(queries.withColumn("time", t).withColumn("frequency", hz), frames, rate, cfg, mode, sizes)


def nearest_index(values: Column, target: Column) -> Column:
    """Index of the value nearest to the target, the first of several."""
    apart = F.transform(values, lambda v: F.abs(v - target))
    return F.array_position(apart, F.array_min(apart)) - 1


def bracket(position: Column, count: Column) -> tuple[Column, Column, Column]:
    """(low, high, fraction) of a fractional index, clamped to both ends."""
    p = F.greatest(F.lit(0.0), F.least((count - 1).cast("double"), position))
    low = F.floor(p)
    return low, F.least(count - 1, low + 1), p - low


def bilinear(positions: DataFrame, frames: DataFrame, bins: int, sizes: DataFrame | None = None) -> DataFrame:
    """Each row (source_id, channel, frame_pos, bin_pos, ...) with the value between frames
    and bins. The two frames are joined on equality, from one exchange."""
    asked = positions.join(frame_counts(frames) if sizes is None else sizes, ["source_id", "channel"])
    f0, f1, ft = bracket(F.col("frame_pos"), F.col("__total"))
    b0, b1, bt = bracket(F.col("bin_pos"), F.lit(bins))
    asked = asked.select("*", f0.alias("__f0"), f1.alias("__f1"), ft.alias("__ft"), b0.cast("int").alias("__b0"), b1.cast("int").alias("__b1"), bt.alias("__bt"))

    def row(suffix):
        return frames.select("source_id", "channel", F.col("frame_idx").alias(f"__f{suffix}"), F.col("mag").alias(f"__m{suffix}"))

    both = asked.join(row(0), ["source_id", "channel", "__f0"]).join(row(1), ["source_id", "channel", "__f1"])
    line = lambda m: F.get(m, F.col("__b0")) * (1 - F.col("__bt")) + F.get(m, F.col("__b1")) * F.col("__bt")
    value = line("__m0") * (1 - F.col("__ft")) + line("__m1") * F.col("__ft")
    return both.select(*positions.columns, value.alias("value"))
