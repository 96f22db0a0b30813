"""Colour maps, rasters, text pictures, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.config import ValueScale, Viewport
from chirpline.functions.colormap import ANCHORS, TAB20, colour_table, colour_tables, stops_of
from chirpline.operators import raster as op
from chirpline.queries.registry import RATE, SMALL, embeddings, frames, query, sizes, stft_cte, table
from chirpline.sources import wav

VIEW, SHOW = Viewport(0.1, 0.95, 1.0, 30.0), ValueScale("magnitude", -60.0, -8.0)
_STOPS = ", ".join(str(tuple(s)) for s in ANCHORS["viridis"])
_LUT = f"""st as (select * from (values {_STOPS}) v(pos, r, g, b)), lut as (
  select i as idx, floor(lo.r + (hi.r - lo.r) * t + 0.5)::int as r, floor(lo.g + (hi.g - lo.g) * t + 0.5)::int as g, floor(lo.b + (hi.b - lo.b) * t + 0.5)::int as b, 255 as a
  from (select i, (select min(pos) from st where pos >= i / 255.0::double)::double as h, (select max(pos) from st where pos <= i / 255.0::double)::double as l from range(256) x(i)) p
  join st hi on hi.pos = p.h join st lo on lo.pos = p.l, lateral (select case when h = l then 0 else (i / 255.0::double - l) / (h - l) end as t))"""


MAPS = ["viridis", "magma", "Turbo", "jet", "tab20", "bone_r"]
_PLACED = ", ".join(str((name, *stop)) for name in MAPS if name != "tab20" for stop in stops_of(name))


@query(
    f"""with st as (select * from (values {_PLACED}) v(map, pos, r, g, b)), p as (select p_partkey, {MAPS}[p_partkey % {len(MAPS)} + 1] as map, (p_partkey * 7 + floor(p_retailprice)::bigint) % 256 as idx from part),
e as (select *, idx / 255.0::double as here from p), b as (select e.*, (select min(pos) from st where st.map = e.map and pos >= here)::double as h, (select max(pos) from st where st.map = e.map and pos <= here)::double as l from e),
c as (select b.*, case when h = l then 0 else (here - l) / (h - l) end as t from b)
select p_partkey, c.map, idx, floor(lo.r + (hi.r - lo.r) * t + 0.5)::int as r, floor(lo.g + (hi.g - lo.g) * t + 0.5)::int as g, floor(lo.b + (hi.b - lo.b) * t + 0.5)::int as b, 255 as a
from c join st hi on hi.map = c.map and hi.pos = c.h join st lo on lo.map = c.map and lo.pos = c.l
union all select p_partkey, map, idx, {[list(c) for c in TAB20]}[idx * 20 // 256 + 1][1]::int, {[list(c) for c in TAB20]}[idx * 20 // 256 + 1][2]::int, {[list(c) for c in TAB20]}[idx * 20 // 256 + 1][3]::int, 255 from p where map = 'tab20'"""
)
def colormap_lut(spark, sf_dir):
    """The colour of each part, by one of several maps."""
    key = F.col("p_partkey")
    named = F.get(F.array(*map(F.lit, MAPS)), (key % len(MAPS)).cast("int")).alias("map")
    parts = table(spark, sf_dir, "part").select("p_partkey", named, ((key * 7 + F.floor("p_retailprice")) % 256).alias("idx"))
    return parts.join(F.broadcast(colour_tables(spark, MAPS)), ["map", "idx"]).select("p_partkey", "map", "idx", "r", "g", "b", "a")


def _values_sql(keys: str, frame_pos: str, bin_pos: str) -> str:
    """v(keys, value): bilinear values at the positions of table g."""
    return f"""q as (select {keys}, {frame_pos} as fr, {bin_pos} as br from g),
q2 as (select {keys}, greatest(0, least(12, fr)) as fp, greatest(0, least(7, br)) as bp from q where fr >= 0 and fr <= 13),
q3 as (select *, floor(fp)::bigint as f0, least(12, floor(fp) + 1)::bigint as f1, floor(bp)::bigint as b0, least(7, floor(bp) + 1)::bigint as b1 from q2),
v as (select {', '.join('q3.' + k for k in keys.split(', '))}, (m00.mag * (1 - (bp - b0)) + m01.mag * (bp - b0)) * (1 - (fp - f0)) + (m10.mag * (1 - (bp - b0)) + m11.mag * (bp - b0)) * (fp - f0) as value from q3
  join m m00 on m00.vec_id = q3.vec_id and m00.frame_idx = f0 and m00.bin = b0 join m m01 on m01.vec_id = q3.vec_id and m01.frame_idx = f0 and m01.bin = b1
  join m m10 on m10.vec_id = q3.vec_id and m10.frame_idx = f1 and m10.bin = b0 join m m11 on m11.vec_id = q3.vec_id and m11.frame_idx = f1 and m11.bin = b1)"""


_NORM = "least(1, greatest(0, (value - pow(10, -60 / 20.0)) / (pow(10, -8 / 20.0) - pow(10, -60 / 20.0))))"


@query(
    f"""with {stft_cte(SMALL)}, {_LUT}, g as (select vec_id, x, y, 0.1 + (x + 0.5) / 12 * (0.95 - 0.1) as t, 30 - (y + 0.5) / 8 * 29 as hz from embeddings, range(12) a(x), range(8) b(y)),
{_values_sql('vec_id, x, y', '(t * 64 - 8) / 4', 'hz * 16 / 64')}
select vec_id, x, y, r, g, b, a from v join lut on idx = least(255, greatest(0, floor({_NORM} * 255 + 0.5)))"""
)
def raster_spectrogram(spark, sf_dir):
    painted = op.raster(frames(spark, sf_dir), colour_table(spark), RATE, SMALL, VIEW, 12, 8, SHOW, sizes=sizes(spark, sf_dir))
    return painted.select(F.col("source_id").cast("long").alias("vec_id"), "x", "y", "r", "g", "b", "a")


_BYTE = "least(255, greatest(0, floor(least(1, greatest(0, (mag - pow(10, -60 / 20.0)) / (pow(10, -8 / 20.0) - pow(10, -60 / 20.0)))) * 255 + 0.5)))"


@query(
    f"""with {stft_cte(SMALL).replace('m as (', 'm0 as (')}, m as (select vec_id, frame_idx, bin, case when bin = 0 then 0 else {_BYTE} end::double as mag from m0), {_LUT},
g as (select vec_id, x, y, 0.1 + (x + 0.5) / 12 * (0.95 - 0.1) as t, 30 - (y + 0.5) / 8 * 29 as hz from embeddings, range(12) a(x), range(8) b(y)),
{_values_sql('vec_id, x, y', '(t * 64 - 8) / 4', 'hz * 16 / 64')}
select vec_id, x, y, r, g, b, a from v join lut on idx = floor(value + 0.5)"""
)
def raster_quantized(spark, sf_dir):
    painted = op.raster(frames(spark, sf_dir), colour_table(spark), RATE, SMALL, VIEW, 12, 8, SHOW, sizes=sizes(spark, sf_dir), interp="quantized")
    return painted.select(F.col("source_id").cast("long").alias("vec_id"), "x", "y", "r", "g", "b", "a")


@query(
    f"""with {stft_cte(SMALL)}, g as (select vec_id, col, "row", (col + 0.5) * ((0.95 - 0.1) / 10) as t, 30 - ("row" + 0.5) / 6 * 29 as hz from embeddings, range(-1, 15) a(col), range(6) b("row")
  where col >= floor((0.1 - (0.95 - 0.1) / 10) / ((0.95 - 0.1) / 10)) and col <= ceil((0.95 + (0.95 - 0.1) / 10) / ((0.95 - 0.1) / 10)) and (col * ((0.95 - 0.1) / 10) - 0.1) / ((0.95 - 0.1) / 10) between -1 and 10),
{_values_sql('vec_id, col, row', '(t * 64 - 8) / 4', 'hz * 16 / 64')}
select vec_id, "row", string_agg(substring(' .:-=+*#%@', 1 + greatest(0, least(9, floor({_NORM} * 10)))::int, 1), '' order by col) as line from v group by 1, 2"""
)
def ascii_spectrogram(spark, sf_dir):
    lines = op.ascii_rows(frames(spark, sf_dir), RATE, SMALL, VIEW, 10, 6, SHOW, sizes=sizes(spark, sf_dir))
    return lines.select(F.col("source_id").cast("long").alias("vec_id"), "row", "line")


@query(
    """with p as (select vec_id, x, y from embeddings, range(24) a(x), range(10) b(y) where (vec_id + x) % 3 <> 0) select vec_id, x, y, (x + y) % 12 < 2 as stripe from p"""
)
def placeholder_hatch(spark, sf_dir):
    grid = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("source_id"), F.lit(0).alias("channel"))
    grid = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return op.hatched(grid, grid.where((F.col("vec_id") + F.col("x")) % 3 == 0)).select("vec_id", "x", "y", "stripe")


@query("select vec_id, len(embedding)::int as n, true as close from embeddings")
def wav_roundtrip(spark, sf_dir):
    """Embeddings as 16-bit files and back, with the largest error of each."""
    chunks = embeddings(spark, sf_dir)
    files = wav.encoded(chunks, 8000).select(F.col("source_id").alias("path"), "content")
    back = wav.chunks_of(files).select("source_id", F.col("x").alias("y"))
    worst = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a)) - b)))
    return chunks.join(back, "source_id").select(F.col("source_id").cast("long").alias("vec_id"), F.size("y").alias("n"), (worst < 1 / 16384).alias("close"))


_TAPS = ", ".join(map(str, op.CELL_TAPS))


@query(
    f"""with {stft_cte(SMALL)}, tp as (select * from (values {_TAPS}) v(a, b, w)), g as (select vec_id, i, j, w, a, b, 0.1 + (i + a) * 3 / 12 * (0.95 - 0.1) as t, 30 - (j + b) * 3 / 8 * 29 as hz from embeddings, range(4) x(i), range(3) y(j), tp where (j + 0.5) * 3 <= 8),
q as (select *, greatest(0, least(12, (t * 64 - 8) / 4)) as fp, greatest(0, least(7, hz * 16 / 64)) as bp from g),
q3 as (select *, floor(fp)::bigint as f0, least(12, floor(fp) + 1)::bigint as f1, floor(bp)::bigint as b0, least(7, floor(bp) + 1)::bigint as b1 from q),
v as (select q3.vec_id, i, j, w, (m00.mag * (1 - (bp - b0)) + m01.mag * (bp - b0)) * (1 - (fp - f0)) + (m10.mag * (1 - (bp - b0)) + m11.mag * (bp - b0)) * (fp - f0) as value from q3
  join m m00 on m00.vec_id = q3.vec_id and m00.frame_idx = f0 and m00.bin = b0 join m m01 on m01.vec_id = q3.vec_id and m01.frame_idx = f0 and m01.bin = b1
  join m m10 on m10.vec_id = q3.vec_id and m10.frame_idx = f1 and m10.bin = b0 join m m11 on m11.vec_id = q3.vec_id and m11.frame_idx = f1 and m11.bin = b1)
select vec_id, i::bigint as i, j::bigint as j, round(1.5 * sqrt(pow(greatest(0, (sum(w::double * {_NORM}) - 0.05) / 0.95), 0.8)), 5) as radius from v group by 1, 2, 3"""
)
def halftone_dots(spark, sf_dir):
    dots = op.halftone(frames(spark, sf_dir), RATE, SMALL, VIEW, 12, 8, ValueScale("magnitude", SHOW.low, SHOW.high), 3.0, 1.5, 0.0, 0.8, 0.05, sizes=sizes(spark, sf_dir))
    return dots.select(F.col("source_id").cast("long").alias("vec_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("radius", 5).alias("radius"))


@query(
    f"""with {_LUT}, l as (select vec_id, (embedding[1]::double + 1) / 2 as v from embeddings) select vec_id, concat('rgb(0, ', floor(100 + v * 155 + 0.5)::int, ', ', floor(v * 50 + 0.5)::int, ')') as green,
concat('rgb(', floor(120 + v * 135 + 0.5)::int, ', ', floor(60 + v * 115 + 0.5)::int, ', 0)') as amber, '#00ff66' as monochrome, concat('rgba(', r, ', ', g, ', ', b, ', 1)') as colormap
from l join lut on idx = greatest(0, least(255, floor(v * 255 + 0.5)))"""
)
def ascii_colours(spark, sf_dir):
    level = (F.get("embedding", 0).cast("double") + 1) / 2
    return table(spark, sf_dir, "embeddings").select("vec_id", *[op.text_colour(level, m).alias(m) for m in ("green", "amber", "monochrome", "colormap")])
