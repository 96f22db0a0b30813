"""Stored tiles: spectra computed once for each setting, filled in as ranges are asked for."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators.stft import Kernel, spectra, stft
from chirpline.operators.transforms import Transform, applied
from chirpline.plans.tiles import settings_hash, tile_key, tile_states
from chirpline.workers import committed

TILE = ["source_id", "channel", "tile_idx"]
KEYS = "source_id string, channel int, tile_idx long, n_frames long, tile_key string, fill string"
FRAMES = "source_id string, channel int, tile_idx long, frame_idx long, mag array<double>, fill string"


class TileStore:
    """Tiles of one setting (transform and its sizes, rate, transforms in order) below a folder.

    Each fill is a folder of frames and, written after them, a folder of the keys of its
    tiles. Keys that are there in full make a fill visible, so a fill that was broken off or
    is still running isn't seen, and fills may run side by side: of tiles that two of them
    computed, readers take one. The last tile of a signal that grew has more frames and so is
    another tile; readers get the one with as many frames as their plan asks for.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: Stft, rate: float, transforms: list[Transform] | None = None, kernel: Kernel = spectra):
        self.spark, self.cfg, self.rate, self.transforms, self.kernel = spark, cfg, rate, transforms or [], kernel
        self.digest = settings_hash(cfg, f"rate={rate}", *(f"{t.name}:{t.frames}" for t in self.transforms))
        self.path = f"{path}/settings={self.digest}"

    def _read(self, part: str, schema: str) -> DataFrame:
        fills = [f"{self.path}/{part}/{name}" for name in committed(self.spark, f"{self.path}/keys")]
        if not fills:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*fills)

    def keys(self) -> DataFrame:
        """(source_id, channel, tile_idx, n_frames, tile_key, fill) of the stored tiles, each once."""
        by = [*TILE, "n_frames", "tile_key"]
        return self._read("keys", KEYS).groupBy(*by).agg(F.min("fill").alias("fill"))

    def missing(self, plan: DataFrame) -> DataFrame:
        """The tiles of a plan (of ``tile_plan``) that aren't stored, each once."""
        return plan.select(*TILE, "n_frames").distinct().join(self.keys(), [*TILE, "n_frames"], "left_anti")

    def states(self, plan: DataFrame) -> DataFrame:
        """The plan with a state for each tile: computed or uncomputed."""
        stored = plan.join(self.keys(), [*TILE, "n_frames"], "left_semi")
        return tile_states(plan, stored)

    def fill(self, chunks: DataFrame, plan: DataFrame) -> None:
        """Compute and store the tiles of the plan that are missing, and no others.

        What is missing is written first and decides what is computed: only chunks that
        such tiles touch are exchanged. Transforms that look at neighbouring frames get the
        tiles beside them as well, which aren't stored.
        """
        fill = f"fill={uuid.uuid4().hex}"
        todo_at = f"{self.path}/todo/{fill}"
        self.missing(plan).write.parquet(todo_at)
        todo = self.spark.read.schema("source_id string, channel int, tile_idx long, n_frames long").parquet(todo_at)
        if todo.isEmpty():
            return
        beside = -(-sum(t.frames for t in self.transforms) // self.cfg.frames_per_tile)
        wanted = todo.select("source_id", "channel", F.explode(F.sequence(F.greatest(F.lit(0), F.col("tile_idx") - beside), F.col("tile_idx") + beside)).alias("tile_idx")).distinct() if beside else todo
        frames = applied(stft(chunks, self.cfg, kernel=self.kernel, wanted=wanted), self.transforms, self.cfg)
        if beside:
            frames = frames.join(todo, TILE, "left_semi")
        frames.select(*TILE, "frame_idx", "mag").sortWithinPartitions(*TILE, "frame_idx").write.parquet(f"{self.path}/frames/{fill}")
        start = F.col("tile_idx") * self.cfg.tile_hop / self.rate
        end = start + ((F.col("n_frames") - 1) * self.cfg.hop + self.cfg.window_size) / self.rate
        keyed = todo.withColumn("tile_key", tile_key(F.col("source_id"), F.col("channel"), start, end, self.digest))
        keyed.write.parquet(f"{self.path}/keys/{fill}")

    def frames(self, plan: DataFrame) -> DataFrame:
        """(source_id, channel, tile_idx, frame_idx, mag) of the plan's tiles that are stored.

        Files are sorted by tile, so that a plan of few tiles skips most row groups.
        """
        wanted = plan.select(*TILE, "n_frames").distinct().join(self.keys(), [*TILE, "n_frames"]).select(*TILE, "fill")
        return self._read("frames", FRAMES).join(wanted, [*TILE, "fill"], "left_semi").drop("fill")

    def through(self, chunks: DataFrame, plan: DataFrame) -> DataFrame:
        """The plan's frames, after a fill of those that were missing."""
        self.fill(chunks, plan)
        return self.frames(plan)

    def computed_twice(self) -> DataFrame:
        """Tiles that fills which ran side by side both hold."""
        return self._read("keys", KEYS).groupBy(*TILE, "n_frames").agg(F.count(F.lit(1)).alias("fills")).where("fills > 1")


def views_of(*plans: DataFrame) -> DataFrame:
    """One plan of several."""
    return reduce(DataFrame.unionByName, plans).distinct()
