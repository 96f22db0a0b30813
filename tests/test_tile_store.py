"""Stored tiles: what a second fill computes, what readers see, what a setting keeps apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators import stft as op
from chirpline.operators.tile_store import TileStore
from chirpline.operators.transforms import smooth_time
from chirpline.plans.tiles import tile_plan, total_frames
from chirpline.sources.signals import chunked, lengths

CFG = Stft(16, 16, 8, tile_cells=8 * 4)


def signal(spark, n, sources=2):
    rng = random.Random(1)
    rows = [(str(s), 0, k, rng.uniform(-1, 1)) for s in range(sources) for k in range(n)]
    return chunked(spark.createDataFrame(rows, "source_id string, channel int, n long, x double"), 25)


def plan(chunks, start, end):
    return tile_plan(lengths(chunks), F.lit(float(start)), F.lit(float(end)), 1.0, total_frames(F.col("n_samples"), CFG), CFG)


def rows(frames):
    return sorted((r["source_id"], r["frame_idx"], tuple(np.round(r["mag"], 9))) for r in frames.collect())


def counted(acc):
    def kernel(x, cfg, weights):
        acc.add(1)
        return op.spectra(x, cfg, weights)

    return kernel


def test_a_second_fill_computes_only_missing_tiles(spark, tmp_path):
    chunks, acc = signal(spark, 1000), spark.sparkContext.accumulator(0)
    store = TileStore(spark, str(tmp_path), CFG, 1.0, kernel=counted(acc))
    store.fill(chunks, plan(chunks, 0, 400))
    first = store.keys().count()
    assert acc.value == first == plan(chunks, 0, 400).count()
    store.fill(chunks, plan(chunks, 200, 700))
    assert acc.value == store.keys().count() == plan(chunks, 0, 700).count()
    store.fill(chunks, plan(chunks, 100, 600))
    assert acc.value == store.keys().count() and store.computed_twice().isEmpty()
    whole = op.stft(chunks, CFG)
    assert rows(store.frames(plan(chunks, 0, 700))) == rows(whole.join(plan(chunks, 0, 700), ["source_id", "channel", "tile_idx"], "left_semi"))
    # what isn't stored isn't read
    assert store.frames(plan(chunks, 900, 990)).count() == 0
    assert rows(store.through(chunks, plan(chunks, 900, 990))) == rows(whole.join(plan(chunks, 900, 990), ["source_id", "channel", "tile_idx"], "left_semi"))


def test_broken_fills_are_not_seen_and_settings_are_apart(spark, tmp_path):
    chunks = signal(spark, 300)
    store = TileStore(spark, str(tmp_path), CFG, 1.0)
    assert store.keys().count() == 0 and store.frames(plan(chunks, 0, 300)).count() == 0
    bad = chunks.select("source_id", "channel", F.lit(0).cast("long").alias("tile_idx"), F.lit(0).cast("long").alias("frame_idx"), F.array(F.lit(9.0)).alias("mag"))
    bad.write.parquet(f"{store.path}/frames/fill=aborted")
    plan(chunks, 0, 50).select("source_id", "channel", "tile_idx", "n_frames").withColumn("tile_key", F.lit("k")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.path}/keys/fill=aborted")
    assert store.keys().count() == 0
    store.fill(chunks, plan(chunks, 0, 300))
    want = rows(op.stft(chunks, CFG))
    assert rows(store.frames(plan(chunks, 0, 300))) == want
    other = TileStore(spark, str(tmp_path), Stft(16, 16, 8, "blackman", tile_cells=32), 1.0)
    smooth = TileStore(spark, str(tmp_path), CFG, 1.0, [smooth_time()])
    assert other.keys().count() == smooth.keys().count() == 0 and len({store.digest, other.digest, smooth.digest}) == 3


def test_tiles_computed_side_by_side_are_read_once(spark, tmp_path):
    chunks = signal(spark, 300)
    store = TileStore(spark, str(tmp_path), CFG, 1.0)
    store.fill(chunks, plan(chunks, 0, 300))
    (name,) = [p.name for p in (tmp_path / store.path / "keys").iterdir()]
    for part in ("keys", "frames"):
        spark.read.parquet(f"{store.path}/{part}/{name}").write.parquet(f"{store.path}/{part}/fill=0000")
    assert store.computed_twice().count() == store.keys().count()
    assert rows(store.frames(plan(chunks, 0, 300))) == rows(op.stft(chunks, CFG))


def test_the_last_tile_of_a_signal_that_grew_is_computed_again(spark, tmp_path):
    short, long = signal(spark, 290, 1), signal(spark, 500, 1)
    store = TileStore(spark, str(tmp_path), CFG, 1.0)
    store.fill(short, plan(short, 0, 290))
    before = store.keys().count()
    store.fill(long, plan(long, 0, 500))
    last = plan(short, 0, 290).orderBy(F.desc("tile_idx")).first()
    assert last["n_frames"] < CFG.frames_per_tile and store.keys().count() == plan(long, 0, 500).count() + 1
    assert rows(store.frames(plan(long, 0, 500))) == rows(op.stft(long, CFG))
    assert rows(store.frames(plan(short, 0, 290))) == rows(op.stft(short, CFG))


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_unwanted_pieces_are_left_out_before_the_exchange(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        chunks = signal(spark, 300)
        planned = op.tiled(chunks, CFG, plan(chunks, 0, 50))._jdf.queryExecution().optimizedPlan().toString()
        top = planned.index("collect_list(")
        assert planned.index("LeftSemi") > top
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_plans(spark, tmp_path):
    chunks = signal(spark, 10)
    store = TileStore(spark, str(tmp_path), CFG, 1.0)
    assert store.through(chunks, plan(chunks, 0, 10)).count() == 0
    assert store.states(plan(signal(spark, 100), 0, 100)).where("state = 'computed'").count() == 0
