"""Files made from the tables, read back; clips, keys and other small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.functions.scales import filled, sought
from chirpline.operators import peaks
from chirpline.plans.tiles import settings_hash, tile_key
from chirpline.queries.registry import EV, SMALL, embeddings, events, frames, query, r, stft_cte, table
from chirpline.sources import mp3, signals, wav
from chirpline.sources.dispatch import kind_of, media_type


def wav_files(spark, sf_dir, **how):
    return wav.encoded(embeddings(spark, sf_dir), 8000, **how).select(F.col("source_id").alias("path"), "content")


@query("select vec_id, 8000 as rate, 1 as channels, 16 as bits, len(embedding)::bigint as n_samples, len(embedding) / 8000.0::double as duration from embeddings")
def wav_headers(spark, sf_dir):
    return wav.headers(wav_files(spark, sf_dir)).select(F.col("path").cast("long").alias("vec_id"), "rate", "channels", "bits", "n_samples", "duration")


_CLAMPED = "greatest(-1, least(1, embedding[n + 1]::double))"


@query(f"select vec_id, n::bigint as n, case when {_CLAMPED} < 0 then floor({_CLAMPED} * 32768 + 0.5) else floor({_CLAMPED} * 32767 + 0.5) end / 32768 as x from embeddings, range(64) t(n)")
def wav_samples(spark, sf_dir):
    back = signals.exploded(wav.chunks_of(wav_files(spark, sf_dir), 25))
    return back.select(F.col("source_id").cast("long").alias("vec_id"), "n", "x")


@query(f"select vec_id, n::bigint as n, trunc({_CLAMPED} * 32767) / 32768 as x from embeddings, range(64) t(n)")
def wav_samples_truncated(spark, sf_dir):
    back = signals.exploded(wav.chunks_of(wav_files(spark, sf_dir, quantizer="trunc")))
    return back.select(F.col("source_id").cast("long").alias("vec_id"), "n", "x")


@query("select vec_id, n::bigint as n, embedding[n + 1]::double as x from embeddings, range(64) t(n) where n >= 10 and n < 31")
def wav_float_range(spark, sf_dir):
    """Samples of a time range of 32-bit float files."""
    back = signals.read_range(wav.chunks_of(wav_files(spark, sf_dir, bits=32), 25), 10 / 8000, 30.5 / 8000, 8000.0)
    return signals.exploded(back).select(F.col("source_id").cast("long").alias("vec_id"), "n", "x")


_WORD = "(4292870144 + (c_custkey * 40503) % 2097152)"
_RATE_ARMS = " ".join(f"when {k} then {v}" for k, v in enumerate(mp3.RATES))
_KBPS_ARMS = " ".join(f"when one = {str(one).lower()} and {'layer' if one else 'least(layer, 2)'} = {layer} then [{', '.join(map(str, t))}][idx]" for (one, layer), t in mp3.BITRATES.items())


@query(
    f"""with w as (select c_custkey, {_WORD}::bigint as w from customer), p as (select *, (w >> 19) & 3 as kind, 4 - ((w >> 17) & 3) as layer, ((w >> 12) & 15) as idx, (w >> 10) & 3 as ra from w),
v as (select *, kind = 3 as one from p where kind <> 1 and layer <> 4 and idx not in (0, 15) and ra <> 3),
k as (select *, (case ra {_RATE_ARMS} end) >> (case kind when 3 then 0 when 2 then 1 else 2 end) as rate, case {_KBPS_ARMS} end as kbps,
  case when layer = 1 then 384 when layer = 2 or one then 1152 else 576 end as samples, (w >> 9) & 1 as pad from v)
select c_custkey, case kind when 3 then 1.0 when 2 then 2.0 else 2.5 end::double as version, layer::bigint as layer, rate::int as rate, kbps::int as kbps, case when (w >> 6) & 3 = 3 then 1 else 2 end::int as channels, samples::int as samples,
  case when layer = 1 then (12 * kbps * 1000 // rate + pad) * 4 else samples // 8 * kbps * 1000 // rate + pad end::bigint as length from k"""
)
def mp3_frame_headers(spark, sf_dir):
    """Header fields of arbitrary sync words."""
    word = F.lit(0xFFE00000) + (F.col("c_custkey") * 40503) % 2097152
    words = table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.lpad(F.hex(word.cast("long")), 8, "0")).alias("content"))
    fields = mp3.header_columns(F.col("content"), F.lit(0).cast("long"))
    return words.select("c_custkey", *[c.alias(k) for k, c in fields.items()]).where("valid").drop("valid")


def mp3_files(spark, sf_dir):
    """One to five frames of 417 bytes, behind a tag of 20 bytes in every third file."""
    frame = F.concat(F.unhex(F.lit("FFFB9000")), F.unhex(F.repeat(F.lit("00"), 413)))
    tag = F.unhex(F.lit("4944330400000000000A" + "00" * 10))
    rows = table(spark, sf_dir, "customer").withColumn("several", F.flatten(F.array_repeat(F.array(F.hex(frame)), (F.col("c_custkey") % 5 + 1).cast("int"))))
    body = F.unhex(F.array_join("several", ""))
    return rows.select("c_custkey", F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_custkey") % 3 == 0, F.concat(tag, body)).otherwise(body).alias("content"))


@query("select c_custkey, 44100 as rate, 2 as channels, 128 as kbps, 417 * (c_custkey % 5 + 1) * 8 / 128000.0::double as duration from customer")
def mp3_durations(spark, sf_dir):
    return mp3.headers(mp3_files(spark, sf_dir)).where("error is null").select(F.col("path").cast("long").alias("c_custkey"), "rate", "channels", "kbps", "duration")


@query("select c_custkey, k as frame_idx, (case when c_custkey % 3 = 0 then 20 else 0 end + k * 417)::bigint as at, 417 as length from customer, lateral (select unnest(range(0, c_custkey % 5 + 1)) as k)")
def mp3_frames(spark, sf_dir):
    return mp3.frame_rows(mp3_files(spark, sf_dir)).select(F.col("path").cast("long").alias("c_custkey"), "frame_idx", "at", "length")


@query("select c_custkey, case c_custkey % 6 when 0 then 'wav' when 1 then 'mp3' when 2 then 'mp3' else 'other' end as kind, case c_custkey % 3 when 0 then 'audio/mpeg' when 1 then 'audio/flac' else 'audio/wav' end as media from customer")
def file_kinds(spark, sf_dir):
    """RIFF files, tags and frames; a byte-order mark, a lone sync and plain text are neither."""
    frame = "FFFB9000" + "00" * 413
    heads = ["52494646000000005741564500", "49443304000000000000", frame + frame, "FFFE41004200430044004500", "FFFB9000" + "00" * 500, "68656C6C6F"]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("c_custkey") % 6).cast("int"))).alias("content"))
    name = F.concat(F.lit("a."), F.get(F.array(F.lit("MP3"), F.lit("flac"), F.lit("wav")), (F.col("c_custkey") % 3).cast("int")))
    return rows.select("c_custkey", kind_of(F.col("content")).alias("kind"), media_type(name).alias("media"))


@query(f"with {EV} select source_id, n, case when n >= 150 and n < 300 then x else 0 end as x from ev")
def clip_of_clip(spark, sf_dir):
    clip = signals.Clip(signals.chunked(events(spark, sf_dir), 64), 100.0, 200.0, 1.0).clip(150.0, 300.0)
    return signals.exploded(clip.chunks()).select("source_id", "n", "x")


@query("select o_orderkey, greatest(coalesce(case when o_orderkey % 2 = 0 then 100.0 end, 0), least(coalesce(case when o_orderkey % 3 = 0 then 1000.0 end, 2000.0), (o_totalprice / 100)))::double as t from orders")
def seek_clamp(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", sought(F.col("o_totalprice") / 100, F.lit(2000.0), F.when(key % 2 == 0, F.lit(100.0)), F.when(key % 3 == 0, F.lit(1000.0))).alias("t"))


@query(f"with {stft_cte(SMALL)} select vec_id, frame_idx, bin, round(case when vec_id % 2 = 0 then 1 else mag * mag end, 7)::double as power, round(case when vec_id % 3 = 0 then -1 else 20 * log10(greatest(1e-12, mag)) end, 3)::double as db from m")
def filled_values(spark, sf_dir):
    fr = frames(spark, sf_dir)
    even, third = F.col("source_id").cast("long") % 2 == 0, F.col("source_id").cast("long") % 3 == 0
    given = fr.withColumn("power", F.when(even, F.transform("mag", lambda m: F.lit(1.0)))).withColumn("db", F.when(third, F.transform("mag", lambda m: F.lit(-1.0))))
    power, db = filled(F.col("mag"), F.col("power"), F.col("db"))
    both = given.select(F.col("source_id").cast("long").alias("vec_id"), "frame_idx", F.posexplode(F.arrays_zip(power.alias("power"), db.alias("db"))).alias("bin", "v"))
    return both.select("vec_id", "frame_idx", "bin", r("v.power", 7).alias("power"), r("v.db", 3).alias("db"))


_DIGEST = settings_hash(SMALL, "gain")


@query(f"select vec_id, concat_ws('|', vec_id::varchar, '0', printf('%.6f', vec_id / 64.0::double), printf('%.6f', (vec_id + 1) / 64.0::double), '{_DIGEST}') as key from embeddings")
def tile_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    return rows.select("vec_id", tile_key(F.col("vec_id").cast("string"), F.lit(0), F.col("vec_id") / 64.0, (F.col("vec_id") + 1) / 64.0, settings_hash(SMALL, "gain")).alias("key"))


@query(f"with {EV} select source_id, n // 32 as k, min(x) as low, max(x) as high from ev where n >= 64 and n < 192 group by 1, 2")
def peaks_rollup(spark, sf_dir):
    level = peaks.bars(events(spark, sf_dir), 72.0, 176.0, 8.0, 1.0)
    return peaks.rolled_up(level, 4).select("source_id", "k", "low", "high")


@query(f"with {EV} select source_id, n, round(50 - x / 500 * 50 * 0.8, 6) as y_px from ev where n >= 9 and n <= 61")
def waveform_outline(spark, sf_dir):
    points = peaks.line(events(spark, sf_dir), 10.0, 60.0, 400, 1.0)
    return points.select("source_id", "n", r(peaks.outline(F.col("y") / 500, 100.0, 0.8)).alias("y_px"))
