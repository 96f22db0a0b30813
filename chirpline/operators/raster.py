"""Spectrograms as pixels and as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft, ValueScale, Viewport
from chirpline.functions.colormap import colour_map
from chirpline.functions.scales import as_byte, hz_at, in_mode, js_round, normalized, time_and_hz
from chirpline.operators.lookup import bilinear, frame_counts

#: From empty to full (fixed value).
CHARSET = " .:-=+*#%@"


def pixel_positions(frames: DataFrame, rate: float, cfg: Stft, view: Viewport, width: int, height: int, scale: str = "linear", sizes: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, x, y, frame_pos, bin_pos) of the pixel centres inside each signal.

    Pixels are generated from each signal's own row; there is no product of tables.
    """
    grid = (frame_counts(frames) if sizes is None else sizes).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    t = F.lit(view.start) + (F.col("x") + 0.5) / width * (view.end - view.start)
    grid = grid.withColumn("frame_pos", (t * rate - cfg.window_size / 2) / cfg.hop).where("frame_pos >= 0 and frame_pos <= __total")
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    hz = hz_at(F.col("y") + 0.5, F.lit(height), F.lit(view.low_hz), F.lit(view.high_hz), scale)
    return grid.select("source_id", "channel", "x", "y", "frame_pos", (hz * cfg.fft_size / rate).alias("bin_pos"))


def values_at(positions: DataFrame, frames: DataFrame, cfg: Stft, mode: str, sizes: DataFrame | None = None) -> DataFrame:
    """Values between frames and bins, interpolated in the units of the mode."""
    shown = frames.withColumn("mag", F.transform("mag", lambda m: in_mode(m, mode)))
    return bilinear(positions, shown, cfg.bins, sizes)


def raster(frames: DataFrame, colours: DataFrame, rate: float, cfg: Stft, view: Viewport, width: int, height: int, show: ValueScale, scale: str = "linear", sizes: DataFrame | None = None, interp: str = "value") -> DataFrame:
    """(source_id, channel, x, y, r, g, b, a). ``colours`` has 256 rows and is broadcast.

    With interp "quantized" values are normalised and rounded to bytes first, as a texture
    holds them, and then interpolated; the lowest bin is blank (0).
    """
    at = pixel_positions(frames, rate, cfg, view, width, height, scale, sizes)
    if interp == "quantized":
        blank = lambda m, k: F.when(k == 0, F.lit(0.0)).otherwise(as_byte(normalized(in_mode(m, show.mode), show)).cast("double"))
        level = bilinear(at, frames.withColumn("mag", F.transform("mag", blank)), cfg.bins, sizes)
        placed = level.withColumn("idx", F.floor(F.col("value") + 0.5).cast("int"))
    else:
        placed = values_at(at, frames, cfg, show.mode, sizes).withColumn("idx", as_byte(normalized(F.col("value"), show)))
    return placed.join(F.broadcast(colours), "idx").select("source_id", "channel", "x", "y", "r", "g", "b", "a")


def hatched(pixels: DataFrame, painted: DataFrame) -> DataFrame:
    """Pixels (source_id, channel, x, y) without paint, with the stripe they show."""
    missing = pixels.join(painted, ["source_id", "channel", "x", "y"], "left_anti")
    return missing.withColumn("stripe", (F.col("x") + F.col("y")) % 12 < 2)


#: Points of a cell, as shares of it, and their weights.
CELL_TAPS = [(0.5, 0.5, 0.36), (0.25, 0.25, 0.16), (0.75, 0.25, 0.16), (0.25, 0.75, 0.16), (0.75, 0.75, 0.16)]


def halftone(frames: DataFrame, rate: float, cfg: Stft, view: Viewport, width: int, height: int, show: ValueScale, cell: float, most: float, angle: float = 0.0, gamma: float = 1.0, threshold: float = 0.0, scale: str = "linear", sizes: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, i, j, radius): dots of a grid of cells turned by ``angle`` radians.

    The area of a dot follows the mean of five points of its cell; cells whose centre lies
    outside the canvas have no dot. Cells are made from each signal's own row.
    """
    turn = (math.cos(angle), math.sin(angle))
    x_of = lambda u, v: u * turn[0] - v * turn[1]
    y_of = lambda u, v: u * turn[1] + v * turn[0]
    corners = [(x * turn[0] + y * turn[1], -x * turn[1] + y * turn[0]) for x in (0, width) for y in (0, height)]
    span = [(math.floor(min(c[k] for c in corners) / cell), math.ceil(max(c[k] for c in corners) / cell) - 1) for k in (0, 1)]
    grid = (frame_counts(frames) if sizes is None else sizes).drop("__total")
    grid = grid.withColumn("i", F.explode(F.sequence(*map(F.lit, span[0])))).withColumn("j", F.explode(F.sequence(*map(F.lit, span[1]))))
    u, v = (F.col("i") + 0.5) * cell, (F.col("j") + 0.5) * cell
    grid = grid.where((x_of(u, v) >= 0) & (x_of(u, v) <= width) & (y_of(u, v) >= 0) & (y_of(u, v) <= height))
    taps = F.array(*[F.struct(((F.col("i") + a) * cell).alias("u"), ((F.col("j") + b) * cell).alias("v"), F.lit(w).alias("w")) for a, b, w in CELL_TAPS])
    at = grid.withColumn("tap", F.explode(taps)).select("source_id", "channel", "i", "j", "tap.*")
    t, hz = time_and_hz(x_of(F.col("u"), F.col("v")), y_of(F.col("u"), F.col("v")), width, height, view, scale)
    at = at.select("source_id", "channel", "i", "j", "w", ((t * rate - cfg.window_size / 2) / cfg.hop).alias("frame_pos"), (hz * cfg.fft_size / rate).alias("bin_pos"))
    means = values_at(at, frames, cfg, show.mode, sizes).groupBy("source_id", "channel", "i", "j").agg(F.sum(F.col("w") * normalized(F.col("value"), show)).alias("mean"))
    energy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("mean") - threshold) / max(1e-4, 1 - threshold)))
    return means.select("source_id", "channel", "i", "j", (most * F.sqrt(F.pow(energy, gamma))).alias("radius"))


def text_colour(level: Column, mode: str = "colormap", colour: str = "#00ff66", colours: str = "viridis") -> Column:
    """CSS colour of a character by its level: that of a colour map, 'green' or 'amber', or one
    for all ('monochrome')."""
    part = lambda base, more: js_round(base + level * more).cast("int")
    if mode == "green":
        return F.format_string("rgb(0, %d, %d)", part(100, 155), part(0, 50))
    if mode == "amber":
        return F.format_string("rgb(%d, %d, 0)", part(120, 135), part(60, 115))
    if mode == "monochrome":
        return F.lit(colour)
    shown = F.array(*[F.lit(f"rgba({r}, {g}, {b}, {a / 255:g})") for r, g, b, a in colour_map(colours)])
    return F.get(shown, F.greatest(F.lit(0), F.least(F.lit(255), js_round(level * 255))).cast("int"))


def ascii_rows(frames: DataFrame, rate: float, cfg: Stft, view: Viewport, columns: int, rows: int, show: ValueScale, scale: str = "linear", charset: str = CHARSET, invert: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, row, line): the spectrogram in characters.

    Columns lie on a grid of absolute time, so text moves with the signal.
    """
    wide = view.seconds / columns
    first, last = math.floor((view.start - wide) / wide), math.ceil((view.end + wide) / wide)
    grid = (frame_counts(frames) if sizes is None else sizes).withColumn("col", F.explode(F.sequence(F.lit(first), F.lit(last))))
    centre = (F.col("col") + 0.5) * wide
    left = (F.col("col") * wide - view.start) / wide
    grid = grid.withColumn("frame_pos", (centre * rate - cfg.window_size / 2) / cfg.hop)
    grid = grid.where((F.col("frame_pos") >= 0) & (F.col("frame_pos") <= F.col("__total")) & (left >= -1) & (left <= columns)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    hz = hz_at(F.col("row") + 0.5, F.lit(rows), F.lit(view.low_hz), F.lit(view.high_hz), scale)
    values = values_at(grid.select("source_id", "channel", "col", "row", "frame_pos", (hz * cfg.fft_size / rate).alias("bin_pos")), frames, cfg, show.mode, sizes)
    level = normalized(F.col("value"), show)
    level = 1 - level if invert else level
    at = F.greatest(F.lit(0), F.least(F.lit(len(charset) - 1), F.floor(level * len(charset)))).cast("int")
    chars = values.select("source_id", "channel", "row", "col", F.substring(F.lit(charset), at + 1, F.lit(1)).alias("c"))
    lines = chars.groupBy("source_id", "channel", "row").agg(F.array_sort(F.collect_list(F.struct("col", "c"))).alias("cs"))
    return lines.select("source_id", "channel", "row", F.array_join(F.transform("cs", lambda s: s["c"]), "").alias("line"))
