"""Tiles: bounded runs of frames on one global grid."""

from __future__ import annotations

import hashlib
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.functions.scales import js_round


def total_frames(n_samples: Column, cfg: Stft) -> Column:
    """Whole frames; a tail shorter than the window is dropped."""
    return F.greatest(F.lit(0), F.floor((n_samples - cfg.window_size) / cfg.hop) + 1)


def frame_at(t: Column, rate: float, total: Column, cfg: Stft) -> Column:
    """The frame whose centre is nearest, half up, inside the signal."""
    return F.greatest(F.lit(0), F.least(total - 1, js_round((t * rate - cfg.window_size / 2) / cfg.hop)))


def nearest_frame(t: Column, rate: float, total: Column, cfg: Stft) -> Column:
    """The frame whose centre is nearest, the lower of two, inside the signal."""
    return F.greatest(F.lit(0), F.least(total - 1, F.ceil((t * rate - cfg.window_size / 2) / cfg.hop - 0.5)))


def tile_at(t: Column, rate: float, total: Column, cfg: Stft) -> Column:
    return F.floor(frame_at(t, rate, total, cfg) / cfg.frames_per_tile)


def frame_span(start: Column, end: Column, rate: float, total: Column, cfg: Stft) -> tuple[Column, Column]:
    """Frames [first, last) that a time range shows, at least one of a signal that has any."""
    first = F.greatest(F.lit(0), F.floor((start * rate - cfg.window_size / 2) / cfg.hop))
    last = F.least(total, F.greatest(first + 1, F.ceil((end * rate - cfg.window_size / 2) / cfg.hop)))
    return first, last


def tile_plan(ranges: DataFrame, start: Column, end: Column, rate: float, total: Column, cfg: Stft) -> DataFrame:
    """A row for each tile of each range: tile_idx, first_frame, n_frames, n_start, n_end."""
    first, last = frame_span(start, end, rate, total, cfg)
    per = cfg.frames_per_tile
    spans = ranges.withColumn("__first", first).withColumn("__last", last).withColumn("__total", total).where("__last > __first")
    tiles = spans.withColumn("tile_idx", F.explode(F.sequence(F.floor(F.col("__first") / per), F.floor((F.col("__last") - 1) / per))))
    head = F.col("tile_idx") * per
    count = F.least(F.lit(per), F.col("__total") - head)
    return tiles.select(
        *ranges.columns,
        "tile_idx",
        head.alias("first_frame"),
        count.alias("n_frames"),
        (head * cfg.hop).alias("n_start"),
        ((head + count - 1) * cfg.hop + cfg.window_size).alias("n_end"),
    )


def tile_states(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """The plan with a state: computed where ``stored`` has the tile."""
    have = stored.select("source_id", "channel", "tile_idx").distinct().withColumn("__have", F.lit(True))
    joined = plan.join(have, ["source_id", "channel", "tile_idx"], "left")
    return joined.withColumn("state", F.when(F.col("__have"), "computed").otherwise("uncomputed")).drop("__have")


def settings_hash(cfg: Stft, *transforms: str) -> str:
    """A short digest of what the values of a tile depend on."""
    said = "|".join([*(f"{f.name}={getattr(cfg, f.name)}" for f in fields(cfg)), *transforms])
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def tile_key(source: Column, channel: Column, start: Column, end: Column, digest: str) -> Column:
    """The key of a stored tile: source, channel, times to a microsecond, settings."""
    return F.concat_ws("|", source, channel.cast("string"), F.format_string("%.6f", start), F.format_string("%.6f", end), F.lit(digest))
