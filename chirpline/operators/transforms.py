"""User transforms of frames, with true halos, and stencils over time and frequency."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft


@dataclass(frozen=True)
class Transform:
    """``apply`` takes and returns the values of a frame, given ``neighbour(k)``, the values
    of the frame k later (earlier if negative), with ends repeated."""

    name: str
    apply: Callable[[Callable[[int], Column]], Column]
    frames: int = 0


def applied(frames: DataFrame, transforms: list[Transform], cfg: Stft) -> DataFrame:
    """All transforms in order.

    Each tile works on its own frames and a halo of its neighbours', so a result doesn't
    depend on tile edges and no task sees more than a tile.
    """
    for t in transforms:
        frames = _one(frames, t, cfg)
    return frames


def _one(frames: DataFrame, transform: Transform, cfg: Stft) -> DataFrame:
    if not transform.frames:
        return frames.withColumn("mag", transform.apply(lambda k: F.col("mag")))
    per, halo = cfg.frames_per_tile, transform.frames
    first, last = F.greatest(F.lit(0), F.floor((F.col("frame_idx") - halo) / per)), F.floor((F.col("frame_idx") + halo) / per)
    sent = frames.withColumn("tile", F.explode(F.sequence(first, last)))
    by = sent.groupBy("source_id", "channel", F.col("tile").alias("tile_idx")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "mag"))).alias("fs"))

    def finished(i: Column) -> Column:
        neighbour = lambda k: F.get("fs", F.greatest(F.lit(0), F.least(F.size("fs") - 1, i + k)))["mag"]
        return F.struct(F.get("fs", i)["frame_idx"].alias("frame_idx"), transform.apply(neighbour).alias("mag"))

    # frames are finished inside the tile's array, so that no row carries more than its own
    own = F.filter(F.sequence(F.lit(0), F.size("fs") - 1), lambda i: F.floor(F.get("fs", i)["frame_idx"] / per) == F.col("tile_idx"))
    return by.select("source_id", "channel", "tile_idx", F.inline(F.transform(own, finished)))


def gain(factor: float) -> Transform:
    return Transform("gain", lambda at: F.transform(at(0), lambda m: m * factor))


def _plus(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * weight)


def smooth_time(weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> Transform:
    """Weighted mean over neighbouring frames."""
    half = len(weights) // 2

    def apply(at):
        out = F.transform(at(-half), lambda m: m * weights[0])
        for k, w in enumerate(weights[1:], 1 - half):
            out = _plus(out, at(k), w)
        return out

    return Transform("smooth_time", apply, half)


def smooth_hz(weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> Transform:
    """Weighted mean over neighbouring bins, with ends repeated."""
    half = len(weights) // 2

    def apply(at):
        m = at(0)
        clamp = lambda i: F.greatest(F.lit(0), F.least(F.size(m) - 1, i))
        return F.transform(m, lambda _, i: sum((F.get(m, clamp(i + k)) * w for k, w in enumerate(weights, -half)), F.lit(0.0)))

    return Transform("smooth_hz", apply)


def blur5(centre: float = 0.5, side: float = 0.125) -> Transform:
    """Five taps: the cell and its four neighbours in time and frequency."""

    def apply(at):
        across = smooth_hz((side, centre, side)).apply(at)
        return _plus(_plus(across, at(-1), side), at(1), side)

    return Transform("blur5", apply, 1)


def contours(interval: float) -> Transform:
    """The contour level of each value, halves up."""
    return Transform("contours", lambda at: F.transform(at(0), lambda v: F.floor(v / interval + 0.5).cast("double")))


def blur9() -> Transform:
    """Nine taps: centre .24, sides .12, corners .07."""
    side, edge = (0.07, 0.12, 0.07), (0.12, 0.24, 0.12)

    def apply(at):
        rows = [smooth_hz(w).apply(lambda _, k=k: at(k)) for k, w in ((-1, side), (0, edge), (1, side))]
        return _plus(_plus(rows[0], rows[1], 1.0), rows[2], 1.0)

    return Transform("blur9", apply, 1)
