"""Tiles over frames and bins, with halos on both axes: no row holds a whole spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.workers import prepare_workers

KEYS = ["source_id", "channel", "tile_idx", "band"]


@dataclass(frozen=True)
class Stencil:
    """``apply`` takes and returns (frames, bins) and looks ``frames`` and ``bins`` cells around
    each; beyond the array it repeats the edge."""

    name: str
    apply: Callable[[np.ndarray], np.ndarray]
    frames: int = 0
    bins: int = 0


def padding(stencils: list[Stencil]) -> tuple[int, int]:
    """The greatest reach of any, over frames and bins."""
    return max((s.frames for s in stencils), default=0), max((s.bins for s in stencils), default=0)


def halo(stencils: list[Stencil]) -> tuple[int, int]:
    """What a chain of them reaches: the sum over frames and over bins."""
    return sum(s.frames for s in stencils), sum(s.bins for s in stencils)


def weighted(name: str, weights: list[list[float]]) -> Stencil:
    """A weighted sum of the cells around, given as rows of frames."""
    w = np.array(weights)
    up, across = w.shape[0] // 2, w.shape[1] // 2

    def apply(x: np.ndarray) -> np.ndarray:
        around = np.pad(x, ((up, up), (across, across)), "edge")
        return sum(w[i, j] * around[i : i + x.shape[0], j : j + x.shape[1]] for i in range(w.shape[0]) for j in range(w.shape[1]))

    return Stencil(name, apply, up, across)


def blur9() -> Stencil:
    """Nine taps: centre .24, sides .12, corners .07."""
    return weighted("blur9", [[0.07, 0.12, 0.07], [0.12, 0.24, 0.12], [0.07, 0.12, 0.07]])


def blur5(centre: float = 0.5, side: float = 0.125) -> Stencil:
    return weighted("blur5", [[0.0, side, 0.0], [side, centre, side], [0.0, side, 0.0]])


def banded(frames: DataFrame, cfg: Stft, bins_per: int, reach: tuple[int, int] = (0, 0), frames_per: int | None = None) -> DataFrame:
    """(source_id, channel, tile_idx, band, frame_idx array, first_bin, cells): frames in order and
    their values from first_bin on, of a tile with its halo.

    Tiles are ``frames_per`` by ``bins_per`` cells. Each frame is cut into bands before the one
    exchange, and sent also to the tiles beside it where it lies in their halo. Beyond the ends of
    a signal and of the spectrum there is no halo.
    """
    per, (up, across) = frames_per or cfg.frames_per_tile, reach
    bands = -(-cfg.bins // bins_per)
    low = lambda k: F.greatest(F.lit(0), k * bins_per - across)
    high = lambda k: F.least(F.lit(cfg.bins), (k + 1) * bins_per + across)
    piece = lambda k: F.struct(k.alias("band"), low(k).alias("first_bin"), F.slice("mag", low(k) + 1, high(k) - low(k)).alias("cells"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("frame_idx") - up) / per)), F.floor((F.col("frame_idx") + up) / per)
    cut = frames.select("source_id", "channel", "frame_idx", "mag", F.explode(F.sequence(first, last)).alias("tile_idx")).select(
        "source_id", "channel", "tile_idx", "frame_idx", F.inline(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), piece))
    )
    by = cut.groupBy(*KEYS, "first_bin").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "cells"))).alias("rows"))
    # a tile beyond the end that holds nothing but the halo of the last is none
    own = F.exists("rows", lambda r: F.floor(r["frame_idx"] / per) == F.col("tile_idx"))
    return by.where(own).select(*KEYS, "first_bin", F.transform("rows", lambda r: r["frame_idx"]).alias("frame_idx"), F.transform("rows", lambda r: r["cells"]).alias("cells"))


def arrays_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(row, frame numbers, first bin, cells) of each tile in a batch of ``banded``."""
    for i in range(batch.num_rows):
        cells = batch.column("cells")[i].values
        yield i, batch.column("frame_idx")[i].values.to_numpy(), batch.column("first_bin")[i].as_py(), cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)


def own_cells(tile: int, band: int, numbers: np.ndarray, first_bin: int, width: int, frames_per: int, bins_per: int) -> tuple[slice, slice]:
    """Where a tile's own cells lie in its array."""
    rows = np.flatnonzero(numbers // frames_per == tile)
    begin = band * bins_per - first_bin
    return slice(rows[0], rows[-1] + 1), slice(begin, min(begin + bins_per, width))


def stencilled(frames: DataFrame, stencils: list[Stencil], cfg: Stft, bins_per: int, frames_per: int | None = None) -> DataFrame:
    """(source_id, channel, frame_idx, first_bin, mag): all stencils in order, in bands of
    ``bins_per`` bins.

    One exchange serves the whole chain: a tile's halo is as wide as all of them reach, so
    its own cells don't depend on where tiles end.
    """
    prepare_workers(frames.sparkSession)
    per = frames_per or cfg.frames_per_tile
    tiles = banded(frames, cfg, bins_per, halo(stencils), per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, numbers, first_bin, x in arrays_of(b):
                for s in stencils:
                    x = s.apply(x)
                tile, band = b.column("tile_idx")[i].as_py(), b.column("band")[i].as_py()
                rows, columns = own_cells(tile, band, numbers, first_bin, x.shape[1], per, bins_per)
                own = x[rows, columns]
                n = len(own)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("source_id")[i].as_py()] * n, pa.string()), pa.array([b.column("channel")[i].as_py()] * n, pa.int32()), pa.array(numbers[rows], pa.int64()), pa.array([band * bins_per] * n, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(own.reshape(-1)))],
                    names=["source_id", "channel", "frame_idx", "first_bin", "mag"],
                )

    return tiles.mapInArrow(run, "source_id string, channel int, frame_idx long, first_bin int, mag array<double>")


def by_cell(bands: DataFrame) -> DataFrame:
    """A row for each cell: (source_id, channel, frame_idx, bin, mag)."""
    return bands.select("source_id", "channel", "frame_idx", "first_bin", F.posexplode("mag").alias("k", "mag")).select("source_id", "channel", "frame_idx", (F.col("first_bin") + F.col("k")).alias("bin"), "mag")


def banded_plan(plan: DataFrame, low_hz: Column, high_hz: Column, rate: float, cfg: Stft, bins_per: int) -> DataFrame:
    """A plan of ``tile_plan`` with a row for each band that a frequency range touches: band,
    first_bin, n_bins, min_hz and max_hz of its bins, start_time and end_time of its frames."""
    bin_at = lambda hz, snap: F.greatest(F.lit(0), F.least(F.lit(cfg.bins - 1), snap(hz * cfg.fft_size / rate)))
    bands = F.sequence(F.floor(bin_at(low_hz, F.floor) / bins_per), F.floor(bin_at(high_hz, F.ceil) / bins_per))
    rows = plan.withColumn("band", F.explode(bands)).withColumn("first_bin", F.col("band") * bins_per)
    rows = rows.withColumn("n_bins", F.least(F.lit(bins_per), cfg.bins - F.col("first_bin")))
    start = (F.col("first_frame") * cfg.hop + cfg.window_size / 2) / rate
    return rows.select(
        "*",
        (F.col("first_bin") * rate / cfg.fft_size).alias("min_hz"),
        ((F.col("first_bin") + F.col("n_bins") - 1) * rate / cfg.fft_size).alias("max_hz"),
        start.alias("start_time"),
        (start + F.col("n_frames") * cfg.hop / rate).alias("end_time"),
    )
