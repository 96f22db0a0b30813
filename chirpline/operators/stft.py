"""Short-time spectra: numpy kernels on Arrow batches, or joins and sums only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.config import WINDOW_TERMS, Stft
from chirpline.workers import prepare_workers

FRAMES = "source_id string, channel int, tile_idx long, frame_idx long, mag array<double>"


def spectra(x: np.ndarray, cfg: Stft, weights: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins): divided by the transform size, without the last bin."""
    if len(x) < cfg.window_size:
        return np.empty((0, cfg.bins))
    frames = np.lib.stride_tricks.sliding_window_view(x, cfg.window_size)[:: cfg.hop]
    return np.abs(np.fft.rfft(frames * weights, cfg.fft_size, axis=1))[:, : cfg.bins] / cfg.fft_size


Kernel = Callable[[np.ndarray, Stft, np.ndarray], np.ndarray]


def _frames_of(rows: DataFrame, cfg: Stft, kernel: Kernel) -> DataFrame:
    """Frames of rows (source_id, channel, tile_idx, x), each holding all samples of its
    tile; the window is made once in a task."""
    prepare_workers(rows.sparkSession)
    per = cfg.frames_per_tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = cfg.weights()
        for b in batches:
            xs, tiles = b.column("x"), b.column("tile_idx").to_numpy()
            for lo in range(0, b.num_rows, 64):
                hi = min(lo + 64, b.num_rows)
                mags = [kernel(xs[i].values.to_numpy(zero_copy_only=False), cfg, weights) for i in range(lo, hi)]
                counts = np.array([len(m) for m in mags])
                rows_at = pa.array(np.repeat(np.arange(lo, hi), counts))
                flat = np.concatenate(mags).reshape(-1) if counts.sum() else np.empty(0)
                offsets = pa.array(np.arange(counts.sum() + 1, dtype=np.int32) * cfg.bins)
                frame = np.concatenate([tiles[i] * per + np.arange(c) for i, c in zip(range(lo, hi), counts)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("source_id").take(rows_at), b.column("channel").take(rows_at), b.column("tile_idx").take(rows_at), pa.array(frame), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["source_id", "channel", "tile_idx", "frame_idx", "mag"],
                )

    return rows.select("source_id", "channel", "tile_idx", "x").mapInArrow(run, FRAMES)


def tiled(chunks: DataFrame, cfg: Stft, wanted: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, tile_idx, x): the samples of each tile with its halo.

    Each chunk is sent, cut to size, to the tiles that it touches, so there is one
    exchange and no group grows with the signal. Pieces that no wanted tile needs are
    left out before it.
    """
    hop, span = cfg.tile_hop, cfg.tile_span
    first = F.greatest(F.lit(0), F.floor((F.col("n0") - span) / hop) + 1)
    last = F.floor((F.col("n0") + F.size("x") - 1) / hop)
    sent = chunks.where(F.size("x") > 0).withColumn("tile_idx", F.explode(F.sequence(first, last)))
    if wanted is not None:
        sent = sent.join(wanted.select("source_id", "channel", "tile_idx").distinct(), ["source_id", "channel", "tile_idx"], "left_semi")
    start = F.greatest(F.col("n0"), F.col("tile_idx") * hop)
    end = F.least(F.col("n0") + F.size("x"), F.col("tile_idx") * hop + span)
    pieces = sent.where(end > start).select("source_id", "channel", "tile_idx", start.alias("n"), F.slice("x", (start - F.col("n0") + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    grouped = pieces.groupBy("source_id", "channel", "tile_idx").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"))
    return grouped.select("source_id", "channel", "tile_idx", F.flatten(F.transform("p", lambda s: s["piece"])).alias("x"))


def stft(chunks: DataFrame, cfg: Stft, tiles: tuple[int, int] | None = None, kernel: Kernel = spectra, wanted: DataFrame | None = None) -> DataFrame:
    """(source_id, channel, tile_idx, frame_idx, mag) of chunked signals.

    ``tiles`` (first, last) restricts the work before the Python stage, since filters
    aren't pushed below it: chunks that no wanted tile needs aren't read. ``wanted``
    (source_id, channel, tile_idx) restricts it to single tiles.
    """
    if tiles:
        low, high = tiles
        chunks = chunks.where((F.col("n0") + F.size("x") > low * cfg.tile_hop) & (F.col("n0") < high * cfg.tile_hop + cfg.tile_span))
    rows = tiled(chunks, cfg, wanted)
    return _frames_of(rows.where(F.col("tile_idx").between(*tiles)) if tiles else rows, cfg, kernel)


def stft_arrays(chunks: DataFrame, cfg: Stft, kernel: Kernel = spectra) -> DataFrame:
    """Frames of signals that are whole in one row: no exchange at all."""
    return _frames_of(chunks.withColumn("tile_idx", F.lit(0).cast("long")), cfg, kernel).withColumn("tile_idx", F.floor(F.col("frame_idx") / cfg.frames_per_tile))


def window_weight(i: Column, cfg: Stft) -> Column:
    if cfg.window_size == 1:
        return F.lit(1.0)
    angle = 2 * F.pi() * i / (cfg.window_size - 1)
    return sum(((-1) ** k * F.lit(a) * F.cos(k * angle) for k, a in enumerate(WINDOW_TERMS[cfg.window])), F.lit(0.0))


def hopping_frames(samples: DataFrame, cfg: Stft) -> DataFrame:
    """(source_id, channel, frame_idx, i, x): each sample in every frame that holds it;
    frames that the tail doesn't fill remain."""
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - cfg.window_size + 1) / cfg.hop))
    last = F.floor(F.col("n") / cfg.hop)
    placed = samples.where(last >= first).withColumn("frame_idx", F.explode(F.sequence(first, last)))
    return placed.select("source_id", "channel", "frame_idx", (F.col("n") - F.col("frame_idx") * cfg.hop).alias("i"), "x").where(F.col("i") < cfg.window_size)


def stft_catalyst(samples: DataFrame, cfg: Stft) -> DataFrame:
    """The same frames by DataFrame functions only: sums over a basis.

    Meant for comparison and small transforms; each sample meets each bin.
    """
    framed = hopping_frames(samples, cfg)
    full = framed.groupBy("source_id", "channel", "frame_idx").agg(F.count(F.lit(1)).alias("m"), F.collect_list(F.struct("i", "x")).alias("s")).where(F.col("m") == cfg.window_size)
    bins = full.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(cfg.bins - 1))))

    def part(wave):
        terms = F.transform("s", lambda s: s["x"] * window_weight(s["i"], cfg) * wave(2 * F.pi() * F.col("bin") * s["i"] / cfg.fft_size))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    return bins.select("source_id", "channel", "frame_idx", "bin", (F.hypot(part(F.cos), part(F.sin)) / cfg.fft_size).alias("mag"))


def by_bin(frames: DataFrame) -> DataFrame:
    """A row for each bin: (source_id, channel, frame_idx, bin, mag)."""
    return frames.select("source_id", "channel", "frame_idx", F.posexplode("mag").alias("bin", "mag"))


def centre_time(frame_idx: Column, rate: float, cfg: Stft) -> Column:
    return (frame_idx * cfg.hop + cfg.window_size / 2) / rate


def bin_hz(bin_idx: Column, rate: float, cfg: Stft) -> Column:
    return bin_idx * rate / cfg.fft_size
