"""Tiles, range reads and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.plans.tiles import tile_at, tile_plan, tile_states, total_frames
from chirpline.queries.registry import EV, events, query, r, table
from chirpline.sources import signals

CFG = Stft(64, 64, 16, tile_cells=32 * 8)
TOTAL = 1000

_TILES = """tile, tile * 8 as first_frame, least(8, total - tile * 8) as n_frames, tile * 128 as n_start, (tile * 8 + least(8, total - tile * 8) - 1) * 16 + 64 as n_end"""


@query(
    f"""with {EV}, c as (select source_id, greatest(0, floor((max(n) + 1 - 64) / 16.0) + 1)::bigint as total from ev group by 1)
select source_id, {_TILES.replace('tile,', 'tile as tile_idx,')} from c, unnest(range(0, (total + 7) // 8)) u(tile) where total > 0"""
)
def tile_plan_full(spark, sf_dir):
    sizes = signals.lengths(signals.chunked(events(spark, sf_dir))).select("source_id", "n_samples")
    return tile_plan(sizes, F.lit(0.0), F.col("n_samples").cast("double"), 1.0, total_frames(F.col("n_samples"), CFG), CFG).drop("n_samples")


@query(
    f"""with v as (select o_orderkey, 1000 as total, (o_orderkey % 60000)::double as t0, (o_orderkey % 60000 + 50 + o_custkey % 900)::double as t1 from orders),
s as (select *, greatest(0, floor((t0 - 32) / 16))::bigint as f0 from v), e as (select *, least(total, greatest(f0 + 1, ceil((t1 - 32) / 16)::bigint)) as f1 from s)
select o_orderkey, {_TILES.replace('tile,', 'tile as tile_idx,')} from e, unnest(range(f0 // 8, (f1 - 1) // 8 + 1)) u(tile) where f1 > f0"""
)
def tile_plan_viewport(spark, sf_dir):
    views = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 60000).cast("double").alias("t0"), (F.col("o_orderkey") % 60000 + 50 + F.col("o_custkey") % 900).cast("double").alias("t1"))
    return tile_plan(views, F.col("t0"), F.col("t1"), 1.0, F.lit(TOTAL), CFG).drop("t0", "t1")


@query("select o_orderkey, floor(greatest(0, least(999, floor((o_totalprice / 10 - 32) / 16 + 0.5))) / 8)::bigint as tile_idx from orders")
def tile_for_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tile_at(F.col("o_totalprice") / 10, 1.0, F.lit(TOTAL), CFG).alias("tile_idx"))


@query(
    f"""with {EV}, c as (select source_id, greatest(0, floor((max(n) + 1 - 64) / 16.0) + 1)::bigint as total from ev group by 1)
select source_id, tile as tile_idx, case when tile % 3 = 0 then 'computed' else 'uncomputed' end as state from c, unnest(range(0, (total + 7) // 8)) u(tile)"""
)
def tile_state(spark, sf_dir):
    plan = tile_plan_full(spark, sf_dir).withColumn("channel", F.lit(0))
    return tile_states(plan, plan.where(F.col("tile_idx") % 3 == 0)).select("source_id", "tile_idx", "state")


@query(f"with {EV} select source_id, n, x from ev where n >= 100 and n < 351")
def read_range(spark, sf_dir):
    return signals.exploded(signals.read_range(signals.chunked(events(spark, sf_dir), 64), 100.5, 350.25, 1.0)).select("source_id", "n", "x")


@query(f"with {EV} select source_id, n, case when n >= 200 and n < 400 then x else 0 end as x from ev")
def clip_zero_pad(spark, sf_dir):
    return signals.exploded(signals.clipped(signals.chunked(events(spark, sf_dir), 64), 200.0, 400.0, 1.0)).select("source_id", "n", "x")


@query(f"with {EV} select source_id, n // 512 * 512 as n0, count(*) as size, round(sum(x), 4) as total from ev group by 1, 2")
def chunk_layout(spark, sf_dir):
    chunks = signals.chunked(events(spark, sf_dir), 512)
    return chunks.select("source_id", "n0", F.size("x").cast("long").alias("size"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))
