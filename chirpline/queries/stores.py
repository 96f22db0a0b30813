"""Tiles that are stored and filled in by one view after another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators.tile_store import TileStore
from chirpline.operators.transforms import smooth_time
from chirpline.plans.tiles import tile_plan, total_frames
from chirpline.queries.registry import EV, events, query, r
from chirpline.sources.signals import chunked, lengths
from chirpline.workers import removed_at_exit, shared_folder

#: Frames in a tile.
PER = 2
STORED = Stft(64, 64, 32, tile_cells=32 * PER)
FIRST, SECOND = (0.0, 120.0), (90.0, 1500.0)


def view(chunks, start, end):
    """The tiles that a time range shows in every signal."""
    sizes = lengths(chunks)
    return tile_plan(sizes, F.lit(start), F.lit(end), 1.0, total_frames(F.col("n_samples"), STORED), STORED)


def stored(spark, sf_dir, transforms=None):
    """The event signals, and a store that two overlapping views have filled."""
    chunks = chunked(events(spark, sf_dir), 200)
    store = TileStore(spark, removed_at_exit(f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"), STORED, 1.0, transforms)
    store.fill(chunks, view(chunks, *FIRST))
    store.fill(chunks, view(chunks, *SECOND))
    return chunks, store


_TOTAL = f"{EV}, c as (select source_id, greatest(0, floor((max(n) + 1 - 64) / 32.0) + 1)::bigint as total from ev group by 1)"


def _tiles(name: str, span: tuple[float, float]) -> str:
    """(source_id, tile) of a view."""
    f0 = f"greatest(0, floor(({span[0]} - 32) / 32))::bigint"
    f1 = f"least(total, greatest({f0} + 1, ceil(({span[1]} - 32) / 32)::bigint))"
    return f"{name} as (select source_id, total, unnest(range({f0} // {PER}, ({f1} - 1) // {PER} + 1)) as tile from c where {f1} > {f0})"


_MAGS = f"""m as (select v.source_id, tile, k as frame_idx, b as bin, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * (n - k * 32) / 63)) * cos(2 * pi() * b * (n - k * 32) / 64)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * (n - k * 32) / 63)) * sin(2 * pi() * b * (n - k * 32) / 64)), 2)) / 64 as mag
  from w v, unnest(range(v.tile * {PER}, least(v.total, v.tile * {PER} + {PER}))) u(k), range(32) g(b), ev where ev.source_id = v.source_id and ev.n between k * 32 and k * 32 + 63 group by all)"""


@query(f"with {_TOTAL}, {_tiles('w', SECOND)}, {_MAGS} select source_id, tile as tile_idx, frame_idx, bin, round(mag, 5) as mag from m")
def tile_store_frames(spark, sf_dir):
    """Frames of the second view: its first tiles were computed for the first."""
    chunks, store = stored(spark, sf_dir)
    found = store.frames(view(chunks, *SECOND))
    return found.select("source_id", "tile_idx", "frame_idx", F.posexplode("mag").alias("bin", "mag")).withColumn("mag", r("mag", 5))


@query(
    f"""with {_TOTAL}, {_tiles('a', FIRST)}, {_tiles('b', SECOND)}
select source_id, 1 as fill_no, count(*) as tiles, min(tile) as first_tile, max(tile) as last_tile from a group by 1
union all select source_id, 2, count(*), min(tile), max(tile) from (select source_id, tile from b except select source_id, tile from a) group by 1"""
)
def tile_store_fills(spark, sf_dir):
    """What each of two fills computed: the second only what the first hadn't."""
    chunks, store = stored(spark, sf_dir)
    first = view(chunks, *FIRST).select("source_id", "tile_idx", F.lit(1).alias("one"))
    marked = store.keys().join(first, ["source_id", "tile_idx"], "left").withColumn("fill_no", F.when(F.col("one") == 1, 1).otherwise(2))
    by_fill = marked.groupBy("source_id", "fill").agg(F.min("fill_no").alias("fill_no"), F.max("fill_no").alias("last_no"), F.count(F.lit(1)).alias("tiles"), F.min("tile_idx").alias("first_tile"), F.max("tile_idx").alias("last_tile"))
    return by_fill.where("fill_no = last_no").drop("fill", "last_no")


@query(
    f"""with {_TOTAL}, {_tiles('a', FIRST)}, {_tiles('b', SECOND)}, s as (select source_id, tile from a union select source_id, tile from b)
select c.source_id, u.tile as tile_idx, case when s.tile is null then 'uncomputed' else 'computed' end as state from c, unnest(range(0, (total + {PER - 1}) // {PER})) u(tile) left join s on s.source_id = c.source_id and s.tile = u.tile"""
)
def tile_store_states(spark, sf_dir):
    chunks, store = stored(spark, sf_dir)
    return store.states(view(chunks, 0.0, 1e9)).select("source_id", "tile_idx", "state")


@query(
    f"""with {_TOTAL}, w as (select source_id, total, unnest(range(0, (total + {PER - 1}) // {PER})) as tile from c), {_MAGS}, {_tiles('b', SECOND)},
t as (select source_id, tile, frame_idx, bin, 0.5 * mag + 0.25 * coalesce(lag(mag) over p, mag) + 0.25 * coalesce(lead(mag) over p, mag) as mag from m window p as (partition by source_id, bin order by frame_idx))
select t.source_id, t.tile as tile_idx, frame_idx, bin, round(mag, 5) as mag from t semi join b on t.source_id = b.source_id and t.tile = b.tile"""
)
def tile_store_smoothed(spark, sf_dir):
    """Stored tiles of a transform that looks at the frames beside, also beyond the tile."""
    chunks, store = stored(spark, sf_dir, [smooth_time()])
    found = store.frames(view(chunks, *SECOND))
    return found.select("source_id", "tile_idx", "frame_idx", F.posexplode("mag").alias("bin", "mag")).withColumn("mag", r("mag", 5))
