"""Stencils over tiles of frames and bins, plans with frequency ranges, contour lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.operators.contours import contour_lines
from chirpline.operators.grid_tiles import banded_plan, blur5, blur9, by_cell, stencilled
from chirpline.plans.tiles import tile_plan
from chirpline.queries import spectra  # noqa: F401
from chirpline.queries.planning import CFG, TOTAL
from chirpline.queries.registry import SMALL, SQL, frames, query, r, stft_cte, table


def _cells(bands):
    return by_cell(bands).select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", "bin", r("mag").alias("mag"))


@query(SQL["stencil_blur"])
def stencil_blur_tiled(spark, sf_dir):
    """The nine taps over tiles of 4 frames and 3 bins."""
    return _cells(stencilled(frames(spark, sf_dir), [blur9()], SMALL, 3, 4))


_NINE = """{o} as (select vec_id, frame_idx, bin, coalesce(lag(side) over v, side) + mid + coalesce(lead(side) over v, side) as mag from (
  select *, 0.07 * coalesce(lag(mag) over w, mag) + 0.12 * mag + 0.07 * coalesce(lead(mag) over w, mag) as side,
    0.12 * coalesce(lag(mag) over w, mag) + 0.24 * mag + 0.12 * coalesce(lead(mag) over w, mag) as mid from {i} window w as (partition by vec_id, frame_idx order by bin)
) window v as (partition by vec_id, bin order by frame_idx))"""


@query(
    f"""with {stft_cte(SMALL)}, {_NINE.format(o='a', i='m')}, {_NINE.format(o='b', i='a')}
select vec_id, frame_idx, bin, round(0.5 * mag + 0.125 * (coalesce(lag(mag) over w, mag) + coalesce(lead(mag) over w, mag) + coalesce(lag(mag) over v, mag) + coalesce(lead(mag) over v, mag)), 6) as mag
from b window w as (partition by vec_id, bin order by frame_idx), v as (partition by vec_id, frame_idx order by bin)"""
)
def stencil_chain_tiled(spark, sf_dir):
    """Three stencils in one exchange, over tiles of 5 frames and 2 bins."""
    return _cells(stencilled(frames(spark, sf_dir), [blur9(), blur9(), blur5()], SMALL, 2, 5))


@query(
    """with v as (select o_orderkey, 1000 as total, (o_orderkey % 60000)::double as t0, (o_orderkey % 60000 + 50 + o_custkey % 900)::double as t1, (o_custkey % 40) / 100.0::double as h0, (o_custkey % 40) / 100.0::double + (o_orderkey % 30) / 100.0::double as h1 from orders),
s as (select *, greatest(0, floor((t0 - 32) / 16))::bigint as f0 from v), e as (select *, least(total, greatest(f0 + 1, ceil((t1 - 32) / 16)::bigint)) as f1 from s),
t as (select o_orderkey, unnest(range(f0 // 8, (f1 - 1) // 8 + 1)) as tile, total, h0, h1 from e where f1 > f0),
b as (select o_orderkey, tile, least(8, total - tile * 8) as n, unnest(range(greatest(0, least(31, floor(h0 * 64)))::bigint // 5, greatest(0, least(31, ceil(h1 * 64)))::bigint // 5 + 1)) as band from t)
select o_orderkey, tile as tile_idx, band, band * 5 as first_bin, least(5, 32 - band * 5) as n_bins, band * 5 / 64.0::double as min_hz, (band * 5 + least(5, 32 - band * 5) - 1) / 64.0::double as max_hz,
  (tile * 8 * 16 + 32)::double as start_time, (tile * 8 * 16 + 32 + n * 16)::double as end_time from b"""
)
def tile_plan_bands(spark, sf_dir):
    """Tiles of time and frequency ranges, one for each order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    low = (customer % 40) / 100.0
    views = table(spark, sf_dir, "orders").select("o_orderkey", (key % 60000).cast("double").alias("t0"), (key % 60000 + 50 + customer % 900).cast("double").alias("t1"), low.alias("h0"), (low + (key % 30) / 100.0).alias("h1"))
    plan = tile_plan(views, F.col("t0"), F.col("t1"), 1.0, F.lit(TOTAL), CFG)
    return banded_plan(plan, F.col("h0"), F.col("h1"), 1.0, CFG, 5).select("o_orderkey", "tile_idx", "band", "first_bin", "n_bins", "min_hz", "max_hz", "start_time", "end_time")


def _edges(least: float, steepest: float) -> str:
    return f"""lv as (select vec_id, frame_idx, bin, round(mag, 9)::double as mag, round(mag, 9)::double / 0.03 as v, floor(round(mag, 9)::double / 0.03 + 0.5)::bigint as level from m),
n as (select *, coalesce(lead(level) over f, level) as l1, coalesce(lead(level) over b, level) as l2, abs(coalesce(lead(v) over f, v) - v) + abs(coalesce(lead(v) over b, v) - v) as change from lv window f as (partition by vec_id, bin order by frame_idx), b as (partition by vec_id, frame_idx order by bin)),
e as (select vec_id, frame_idx, bin, level, frame_idx * 8 + bin as cell from n where (l1 <> level or l2 <> level) and mag >= {least} and change <= {steepest})"""


@query(
    f"""with recursive {stft_cte(SMALL)}, {_edges(0.02, 3.0)},
k as (select a.vec_id, a.cell as x, b.cell as y from e a join e b on a.vec_id = b.vec_id and abs(a.frame_idx - b.frame_idx) <= 1 and abs(a.bin - b.bin) <= 1),
c as (select vec_id, cell, cell as root from e union select c.vec_id, k.y, c.root from c join k on k.vec_id = c.vec_id and k.x = c.cell and k.y > c.root)
select e.vec_id, e.frame_idx, e.bin, e.level, min(root) as line from e join c on c.vec_id = e.vec_id and c.cell = e.cell group by all"""
)
def contour_line_cells(spark, sf_dir):
    """Cells of contour lines, linked over tiles of 4 frames and 3 bins."""
    rounded = frames(spark, sf_dir).withColumn("mag", F.transform("mag", lambda m: F.round(m, 9)))
    found = contour_lines(rounded, SMALL, 0.03, 0.02, 3.0, 3, 4)
    return found.select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", "bin", "level", "line")
