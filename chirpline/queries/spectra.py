"""Short-time spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.functions.scales import db_of, in_mode
from chirpline.operators import stft as op
from chirpline.operators.transforms import applied, blur5, blur9, contours, gain, smooth_hz, smooth_time
from chirpline.plans.tiles import total_frames
from chirpline.queries.registry import EV, RATE, SMALL, embeddings, events, frames, query, r, stft_cte, table
from chirpline.sources.signals import chunked, lengths, ordered_signal


def _bins(fr):
    return op.by_bin(fr).select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", "bin", "mag")


for _short, _window in (("hann", "hann"), ("hamming", "hamming"), ("blackman", "blackman"), ("rect", "rectangular")):
    _cfg = Stft(64, 64, 16, _window)

    @query(f"with {stft_cte(_cfg)} select vec_id, frame_idx, bin, round(mag, 6) as mag from m", name=f"stft_{_short}_64")
    def _(spark, sf_dir, cfg=_cfg):
        return _bins(frames(spark, sf_dir, cfg)).withColumn("mag", r("mag"))


PADDED = Stft(48, 64, 16)


@query(f"with {stft_cte(PADDED)} select vec_id, frame_idx, bin, round(mag, 6) as mag from m")
def stft_zero_padded(spark, sf_dir):
    return _bins(frames(spark, sf_dir, PADDED)).withColumn("mag", r("mag"))


@query(f"with {stft_cte(SMALL)} select vec_id, frame_idx, bin, round(mag * mag, 7) as power from m")
def stft_power(spark, sf_dir):
    return _bins(frames(spark, sf_dir)).select("vec_id", "frame_idx", "bin", r(in_mode(F.col("mag"), "power"), 7).alias("power"))


@query(f"with {stft_cte(SMALL)} select vec_id, frame_idx, bin, round(20 * log10(greatest(1e-12, abs(mag))), 3) as db from m")
def stft_db(spark, sf_dir):
    return _bins(frames(spark, sf_dir)).select("vec_id", "frame_idx", "bin", r(db_of(F.col("mag")), 3).alias("db"))


@query(f"with {stft_cte(SMALL)} select vec_id, frame_idx, bin, round(mag, 6) as mag from m")
def stft_catalyst(spark, sf_dir):
    samples = embeddings(spark, sf_dir).select("source_id", "channel", F.posexplode("x").alias("n", "x"))
    return op.stft_catalyst(samples, SMALL).select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", "bin", r("mag").alias("mag"))


EVENTS = Stft(64, 64, 32, tile_cells=64 * 32)


@query(
    f"""with {EV}, c as (select source_id, max(n) + 1 as total from ev group by 1), f as (
  select e.source_id, k as frame_idx, e.n - k * 32 as i, x * (0.5 - 0.5 * cos(2 * pi() * (e.n - k * 32) / 63)) as v
  from ev e join c on e.source_id = c.source_id, unnest(range(greatest(0, ceil((e.n - 63) / 32.0)::bigint), floor(e.n / 32.0)::bigint + 1)) u(k)
  where k < greatest(0, floor((total - 64) / 32.0) + 1))
select source_id, frame_idx, b as bin, round(sqrt(pow(sum(v * cos(2 * pi() * b * i / 64)), 2) + pow(sum(v * sin(2 * pi() * b * i / 64)), 2)) / 64, 5) as mag
from f, range(32) g(b) group by all"""
)
def stft_tiled_events(spark, sf_dir):
    """Long signals in chunks: tiles with halos, one exchange for the samples."""
    fr = op.stft(chunked(events(spark, sf_dir), 500), EVENTS)
    return op.by_bin(fr).select("source_id", "frame_idx", "bin", r("mag", 5).alias("mag"))


LONG = Stft(64, 64, 16)


@query(f"with {EV}, c as (select source_id, max(n) + 1 as n_samples from ev group by 1) select source_id, n_samples, greatest(0, floor((n_samples - 64) / 16.0) + 1)::bigint as frame_count from c")
def frame_count(spark, sf_dir):
    sizes = lengths(chunked(events(spark, sf_dir)))
    return sizes.select("source_id", "n_samples", total_frames(F.col("n_samples"), LONG).alias("frame_count"))


@query("select vec_id, f as frame_idx, round((f * 4 + 8) / 64.0, 6) as t from embeddings, range(13) a(f)")
def frame_times(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", r(op.centre_time(F.col("frame_idx"), RATE, SMALL)).alias("t"))


@query(
    f"""with {EV}, f as (select source_id, x, k from ev, unnest(range(greatest(0, ceil((n - 63) / 16.0)::bigint), floor(n / 16.0)::bigint + 1)) u(k))
select source_id, k as frame_idx, count(*) as n_in, round(sum(x), 4) as sum_x, min(x) as low, max(x) as high from f group by 1, 2 having count(*) = 64"""
)
def frames_hopping_events(spark, sf_dir):
    framed = op.hopping_frames(events(spark, sf_dir), LONG)
    by = framed.groupBy("source_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_in"), r(F.sum("x"), 4).alias("sum_x"), F.min("x").alias("low"), F.max("x").alias("high"))
    return by.where(F.col("n_in") == LONG.window_size)


@query(
    f"""with {stft_cte(SMALL)}, t as (
  select vec_id, frame_idx, bin, 2 * (0.25 * coalesce(lag(mag) over w, mag) + 0.5 * mag + 0.25 * coalesce(lead(mag) over w, mag)) as mag from m window w as (partition by vec_id, bin order by frame_idx)
) select vec_id, frame_idx, bin, round(0.25 * coalesce(lag(mag) over v, mag) + 0.5 * mag + 0.25 * coalesce(lead(mag) over v, mag), 6) as mag from t window v as (partition by vec_id, frame_idx order by bin)"""
)
def transform_chain(spark, sf_dir):
    """Gain, then smoothing over time with halos, then over frequency."""
    cfg = Stft(16, 16, 4, tile_cells=8 * 4)
    return _bins(applied(frames(spark, sf_dir, cfg), [gain(2.0), smooth_time(), smooth_hz()], cfg)).withColumn("mag", r("mag"))


@query(
    f"""with {stft_cte(SMALL)}, t as (
  select vec_id, frame_idx, bin, 0.07 * coalesce(lag(mag) over w, mag) + 0.12 * mag + 0.07 * coalesce(lead(mag) over w, mag) as side,
    0.12 * coalesce(lag(mag) over w, mag) + 0.24 * mag + 0.12 * coalesce(lead(mag) over w, mag) as mid from m window w as (partition by vec_id, frame_idx order by bin)
) select vec_id, frame_idx, bin, round(coalesce(lag(side) over v, side) + mid + coalesce(lead(side) over v, side), 6) as mag from t window v as (partition by vec_id, bin order by frame_idx)"""
)
def stencil_blur(spark, sf_dir):
    return _bins(applied(frames(spark, sf_dir), [blur9()], SMALL)).withColumn("mag", r("mag"))


@query(
    f"""with {stft_cte(SMALL)} select vec_id, frame_idx, bin, round(0.5 * mag + 0.125 * (coalesce(lag(mag) over w, mag) + coalesce(lead(mag) over w, mag) + coalesce(lag(mag) over v, mag) + coalesce(lead(mag) over v, mag)), 6) as mag
from m window w as (partition by vec_id, bin order by frame_idx), v as (partition by vec_id, frame_idx order by bin)"""
)
def stencil_five(spark, sf_dir):
    return _bins(applied(frames(spark, sf_dir), [blur5()], SMALL)).withColumn("mag", r("mag"))


@query(f"with {stft_cte(SMALL)} select vec_id, frame_idx, bin, floor(round(mag, 9) / 0.03 + 0.5)::bigint as level from m")
def contour_levels(spark, sf_dir):
    rounded = frames(spark, sf_dir).withColumn("mag", F.transform("mag", lambda m: F.round(m, 9)))
    return _bins(applied(rounded, [contours(0.03)], SMALL)).select("vec_id", "frame_idx", "bin", F.col("mag").cast("long").alias("level"))


TRACK = Stft(1024, 1024, 256)


@query(
    """with s as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as n, l_extendedprice::double / 1e5 as x from lineitem), c as (select max(n) + 1 as total from s), f as (
  select k as frame_idx, n - k * 256 as i, x * (0.5 - 0.5 * cos(2 * pi() * (n - k * 256) / 1023)) as v
  from s, c, unnest(range(greatest(0, ceil((n - 1023) / 256.0)::bigint), floor(n / 256.0)::bigint + 1)) u(k) where k < greatest(0, floor((total - 1024) / 256.0) + 1))
select frame_idx, b as bin, round(sqrt(pow(sum(v * cos(2 * pi() * b * i / 1024)), 2) + pow(sum(v * sin(2 * pi() * b * i / 1024)), 2)) / 1024, 6) as mag from f, range(4) g(b) group by all"""
)
def stft_long_signal(spark, sf_dir):
    """The lowest bins of one signal as long as ``lineitem``."""
    items = table(spark, sf_dir, "lineitem")
    signal = ordered_signal(items, F.lit("l"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_extendedprice") / 1e5, F.floor(F.col("l_orderkey") / 4096))
    return op.by_bin(op.stft(chunked(signal), TRACK)).where("bin < 4").select("frame_idx", "bin", r("mag").alias("mag"))
