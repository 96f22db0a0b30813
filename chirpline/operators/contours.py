"""Contour lines: cells at which the level changes, linked to lines across tiles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators.components import components
from chirpline.operators.grid_tiles import arrays_of, banded, own_cells
from chirpline.workers import prepare_workers, removed_at_exit, shared_folder

CELL = "struct<frame_idx:bigint,bin:int,level:bigint,label:bigint>"
LINK = "struct<label:bigint,other:bigint>"
#: Directions of the eight cells around one.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def edge_mask(x: np.ndarray, interval: float, least: float, steepest: float) -> tuple[np.ndarray, np.ndarray]:
    """(mask, levels): cells whose level differs from that of the next frame's or the next bin's
    cell, unless the value is below ``least`` or changes by more than ``steepest`` levels."""
    scaled = x / interval
    level = np.floor(scaled + 0.5)
    ahead = lambda a, axis: np.concatenate([a.take(range(1, a.shape[axis]), axis), a.take([-1], axis)], axis)
    change = np.abs(ahead(scaled, 0) - scaled) + np.abs(ahead(scaled, 1) - scaled)
    return ((ahead(level, 0) != level) | (ahead(level, 1) != level)) & (x >= least) & (change <= steepest), level.astype(np.int64)


def labelled(mask: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each cell of the mask the least number of the cells that it is connected with."""
    far = np.iinfo(np.int64).max
    label = np.where(mask, numbers, far)
    while True:
        framed = np.pad(label, 1, constant_values=far)
        least = label
        for i, j in AROUND:
            least = np.minimum(least, framed[1 + i : 1 + i + mask.shape[0], 1 + j : 1 + j + mask.shape[1]])
        least = np.where(mask, least, far)
        if (least == label).all():
            return label
        label = least


def contour_lines(frames: DataFrame, cfg: Stft, interval: float, least: float = 0.0, steepest: float = np.inf, bins_per: int = 64, frames_per: int | None = None) -> DataFrame:
    """(source_id, channel, frame_idx, bin, level, line): the cells of all contour lines.

    Cells that touch, also at corners, are one line; its number is that of its first cell
    (frame_idx * bins + bin). Lines are linked inside each tile, then over the borders of
    tiles by components of the tiles' lines, so no task sees more than a tile.
    """
    spark = frames.sparkSession
    prepare_workers(spark)
    per, total = frames_per or cfg.frames_per_tile, cfg.bins
    # whether a cell beside a tile is an edge depends on the cells after it
    tiles = banded(frames, cfg, bins_per, (2, 2), per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, numbers, first_bin, x in arrays_of(b):
                mask, level = edge_mask(x, interval, least, steepest)
                rows, columns = own_cells(b.column("tile_idx")[i].as_py(), b.column("band")[i].as_py(), numbers, first_bin, x.shape[1], per, bins_per)
                cell = numbers[:, None] * total + first_bin + np.arange(x.shape[1])
                own = np.zeros_like(mask)
                own[rows, columns] = mask[rows, columns]
                label = labelled(own[rows, columns], cell[rows, columns])
                at = np.argwhere(own)
                cells = [{"frame_idx": int(numbers[r]), "bin": int(first_bin + c), "level": int(level[r, c]), "label": int(label[r - rows.start, c - columns.start])} for r, c in at]
                links = {
                    (int(label[r - rows.start, c - columns.start]), int(cell[r + u, c + v]))
                    for r, c in at
                    for u, v in AROUND
                    if 0 <= r + u < mask.shape[0] and 0 <= c + v < mask.shape[1] and mask[r + u, c + v] and not (rows.start <= r + u < rows.stop and columns.start <= c + v < columns.stop)
                }
                yield pa.RecordBatch.from_arrays(
                    [b.column("source_id").slice(i, 1), b.column("channel").slice(i, 1), pa.array([cells], found["cells"]), pa.array([[{"label": a, "other": o} for a, o in sorted(links)]], found["links"])],
                    names=["source_id", "channel", "cells", "links"],
                )

    cell_type = pa.struct([("frame_idx", pa.int64()), ("bin", pa.int32()), ("level", pa.int64()), ("label", pa.int64())])
    found = {"cells": pa.list_(cell_type), "links": pa.list_(pa.struct([("label", pa.int64()), ("other", pa.int64())]))}
    at = removed_at_exit(f"{shared_folder(spark)}/contours-{uuid.uuid4().hex}")
    tiles.mapInArrow(run, f"source_id string, channel int, cells array<{CELL}>, links array<{LINK}>").write.parquet(at)
    made = spark.read.parquet(at)
    cells = made.select("source_id", "channel", F.inline("cells"))
    crossing = made.select("source_id", "channel", F.inline("links"))
    # the cell on the other side, by its number, tells that side's label
    there = cells.select("source_id", "channel", (F.col("frame_idx") * total + F.col("bin")).alias("other"), F.col("label").alias("their"))
    node = lambda c: F.struct("source_id", "channel", F.col(c).alias("label"))
    roots = components(crossing.join(there, ["source_id", "channel", "other"]).select(node("label").alias("a"), node("their").alias("b")))
    known = roots.select("node.source_id", "node.channel", "node.label", F.col("root.label").alias("root"))
    joined = cells.join(known, ["source_id", "channel", "label"], "left")
    return joined.select("source_id", "channel", "frame_idx", "bin", "level", F.coalesce("root", "label").alias("line"))
