"""Spectrum, frame, point and pixel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.config import Viewport
from chirpline.operators import lookup
from chirpline.config import Stft
from chirpline.operators.stft import stft
from chirpline.queries.registry import EV, RATE, SMALL, events, frames, query, r, sizes, stft_cte, table
from chirpline.sources.signals import chunked

_M = stft_cte(SMALL)
_TIMES = "t as (select vec_id, k, (vec_id % 7 * 0.031 + k * 0.29)::double as time from embeddings, range(3) a(k))"
_FRAME = "greatest(0, least(12, ceil((time * 64 - 8) / 4 - 0.5)))::bigint"


def _asked(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return ids.select(F.col("vec_id").cast("string").alias("source_id"), F.lit(0).alias("channel"), "vec_id", "k", (F.col("vec_id") % 7 * F.lit(0.031) + F.col("k") * F.lit(0.29)).alias("time"))


@query(f"with {_M}, {_TIMES}, q as (select *, {_FRAME} as f from t) select q.vec_id, k, frame_idx, bin, round(20 * log10(greatest(1e-12, mag)), 3) as value from q join m on m.vec_id = q.vec_id and m.frame_idx = q.f")
def query_spectrum(spark, sf_dir):
    found = lookup.query_spectrum(_asked(spark, sf_dir), frames(spark, sf_dir), RATE, SMALL, "db", sizes(spark, sf_dir))
    return found.select("vec_id", "k", "frame_idx", F.posexplode("values").alias("bin", "value")).withColumn("value", r("value", 3))


@query(f"with {_M} select vec_id, bin, round(mag * mag, 7) as value from m where frame_idx = 5")
def query_frame(spark, sf_dir):
    found = lookup.query_frame(frames(spark, sf_dir), 5, "power")
    return found.select(F.col("source_id").cast("long").alias("vec_id"), F.posexplode("values").alias("bin", "value")).withColumn("value", r("value", 7))


@query(
    f"""with {_M}, {_TIMES}, q as (select *, {_FRAME} as f, greatest(0, least(7, ceil((vec_id % 33)::double * 16 / 64 - 0.5)))::int as b from t)
select q.vec_id, k, f as frame_idx, b as bin, round(mag, 6) as value from q join m on m.vec_id = q.vec_id and m.frame_idx = f and m.bin = b"""
)
def query_point(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("frequency", (F.col("vec_id") % 33).cast("double"))
    return lookup.query_point(asked, frames(spark, sf_dir), RATE, SMALL, sizes=sizes(spark, sf_dir)).select("vec_id", "k", "frame_idx", "bin", r("value").alias("value"))


@query(
    f"""with {_M}, p as (select vec_id, 0.1 + (vec_id % 101)::double / 100 * 0.8 as time, 32 - (vec_id % 37)::double / 40 * 32 as f from embeddings),
q as (select vec_id, {_FRAME} as fi, greatest(0, least(7, ceil(f * 16 / 64 - 0.5)))::int as b from p)
select q.vec_id, fi as frame_idx, b as bin, round(mag, 6) as value from q join m on m.vec_id = q.vec_id and m.frame_idx = fi and m.bin = b"""
)
def query_canvas_point(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("source_id"), F.lit(0).alias("channel"), (F.col("vec_id") % 101).cast("double").alias("x"), (F.col("vec_id") % 37).cast("double").alias("y"))
    found = lookup.query_pixel(pixels, frames(spark, sf_dir), RATE, SMALL, Viewport(0.1, 0.9, 0.0, 32.0), 100, 40, sizes=sizes(spark, sf_dir))
    return found.select("vec_id", "frame_idx", "bin", r("value").alias("value"))


@query(
    """with e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select vec_id, arg_min(i, struct_pack(d := abs(v - 0.25), i := i))::bigint as i from e group by 1"""
)
def nearest_index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", lookup.nearest_index(F.col("embedding").cast("array<double>"), F.lit(0.25)).cast("long").alias("i"))


@query(
    f"""with {_M}, p as (select vec_id, least(12, (vec_id % 131)::double / 10) as fp, least(7, (vec_id % 77)::double / 10) as bp from embeddings),
q as (select *, floor(fp)::bigint as f0, least(12, floor(fp) + 1)::bigint as f1, floor(bp)::bigint as b0, least(7, floor(bp) + 1)::bigint as b1 from p)
select q.vec_id, round(sum(m.mag * (case when m.frame_idx = f0 then 1 - (fp - f0) else 0 end + case when m.frame_idx = f1 then fp - f0 else 0 end)
  * (case when m.bin = b0 then 1 - (bp - b0) else 0 end + case when m.bin = b1 then bp - b0 else 0 end)), 6) as value
from q join m on m.vec_id = q.vec_id and m.frame_idx in (f0, f1) and m.bin in (b0, b1) group by 1"""
)
def bilinear_sample(spark, sf_dir):
    at = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("source_id"), F.lit(0).alias("channel"), "vec_id", ((F.col("vec_id") % 131).cast("double") / 10).alias("frame_pos"), ((F.col("vec_id") % 77).cast("double") / 10).alias("bin_pos")
    )
    return lookup.bilinear(at, frames(spark, sf_dir), SMALL.bins, sizes(spark, sf_dir)).select("vec_id", r("value").alias("value"))


LONG = Stft(64, 64, 16, tile_cells=32 * 8)


@query(
    f"""with {EV}, c as (select source_id, floor((max(n) + 1 - 64) / 16.0)::bigint + 1 as total from ev group by 1 having max(n) + 1 >= 64),
q as (select source_id, k, (k * 31 + 5)::double as time, least(total - 1, greatest(0, ceil((k * 31 + 5 - 32) / 16.0 - 0.5)))::bigint as frame_idx from c, range(4) t(k)),
f as (select q.source_id, k, frame_idx, n - frame_idx * 16 as i, x * (0.5 - 0.5 * cos(2 * pi() * (n - frame_idx * 16) / 63)) as v from q join ev on ev.source_id = q.source_id and n >= frame_idx * 16 and n < frame_idx * 16 + 64)
select source_id, k, frame_idx, round(sqrt(pow(sum(v * cos(2 * pi() * 7 * i / 64)), 2) + pow(sum(v * sin(2 * pi() * 7 * i / 64)), 2)) / 64, 5) as value from f group by 1, 2, 3"""
)
def query_point_long(spark, sf_dir):
    """A few points of long signals: only the tiles that they lie in are computed."""
    chunks = chunked(events(spark, sf_dir), 100)
    counts = lookup.frame_sizes(chunks, LONG)
    asked = counts.select("source_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("k"))
    asked = asked.withColumn("time", (F.col("k") * 31 + 5).cast("double")).withColumn("frequency", F.lit(7 / 64))
    wanted = lookup.asked_frames(asked, counts, 1.0, LONG)
    found = lookup.query_point(asked, stft(chunks, LONG, wanted=wanted), 1.0, LONG, sizes=counts)
    return found.select("source_id", "k", "frame_idx", r("value", 5).alias("value"))
