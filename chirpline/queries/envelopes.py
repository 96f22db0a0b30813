"""Peaks, statistics and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.operators import intervals, peaks, stats
from chirpline.queries.registry import EV, events, query, r, table
from chirpline.sources.signals import chunked, exploded, lengths


@query(
    f"""with {EV}, c as (select source_id, max(n) + 1 as len from ev group by 1), e as (
  select source_id, k, floor(k * (len::double / least(len, 100)))::bigint as a, floor((k + 1) * (len::double / least(len, 100)))::bigint as b from c, unnest(range(0, least(len, 100))) u(k))
select e.source_id, k, min(x) as low, max(x) as high from e join ev on ev.source_id = e.source_id and n >= a and n < b group by 1, 2"""
)
def peaks_decimate(spark, sf_dir):
    return peaks.decimated(events(spark, sf_dir), 100).drop("channel")


@query(
    f"""with {EV}, b as (select k, floor(k * 2.5 + 0.5)::bigint as a, floor((k + 1) * 2.5 + 0.5)::bigint as z from range(39, 242) t(k))
select source_id, k, (k + 0.5) * 2.5 as t_center, round(((k + 0.5) * 2.5 - 100) / 500 * 200, 6) as x_px, min(x) as low, max(x) as high from b join ev on n >= a and n < z group by 1, 2"""
)
def peaks_envelope(spark, sf_dir):
    return peaks.envelope(events(spark, sf_dir), 100.0, 600.0, 200, 1.0).drop("channel").withColumn("x_px", r("x_px"))


@query(f"with {EV} select source_id, n, round((n - 100.5) / 60 * 800, 6) as x_px, x as y from ev where n >= 99 and n <= 162")
def peaks_line(spark, sf_dir):
    return peaks.line(events(spark, sf_dir), 100.5, 160.5, 800, 1.0).drop("channel").withColumn("x_px", r("x_px"))


@query(f"with {EV}, b as (select k, floor(k * 7.3 + 0.5)::bigint as a, floor((k + 1) * 7.3 + 0.5)::bigint as z from range(12, 85) t(k)) select source_id, k, min(x) as low, max(x) as high from b join ev on n >= a and n < z group by 1, 2")
def peaks_bars(spark, sf_dir):
    return peaks.bars(events(spark, sf_dir), 100.0, 600.0, 7.3, 1.0).drop("channel")


@query(
    """with p as (select vec_id, list_min(embedding)::double as lo, list_max(embedding)::double as hi from embeddings), q as (select *, greatest(abs(lo), abs(hi)) as peak from p)
select vec_id, round(100 - greatest(1.5, peak * 100), 6) as top, round(100 + greatest(1.5, peak * 100), 6) as bottom, round(2 * greatest(1.5, peak * 100), 6) as height, round(200 - greatest(2, peak * 200), 6) as bottom_aligned from q"""
)
def bar_geometry(spark, sf_dir):
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    top, bottom, height = peaks.bar_geometry(low, high, 200)
    other, _, _ = peaks.bar_geometry(low, high, 200, align="bottom")
    return table(spark, sf_dir, "embeddings").select("vec_id", r(top).alias("top"), r(bottom).alias("bottom"), r(height).alias("height"), r(other).alias("bottom_aligned"))


@query(f"with {EV} select source_id, n, min(x) over w as low, max(x) over w as high, round(avg(x) over w, 8) as mean from ev window w as (partition by source_id order by n rows between 59 preceding and current row)")
def rolling_stats_60(spark, sf_dir):
    return stats.rolling(events(spark, sf_dir), 60).withColumn("mean", r("mean", 8))


@query(f"with {EV} select source_id, n // 30 as k, min(x) as low, max(x) as high, round(avg(x), 6) as mean, round(1000 / avg(x), 6) as rate from ev group by 1, 2 having count(*) = 30")
def frame_meter_30(spark, sf_dir):
    return stats.tumbling(events(spark, sf_dir), 30).withColumn("mean", r("mean")).withColumn("rate", r("rate"))


@query(
    f"""with {EV}, o as (select source_id, x, row_number() over (partition by source_id order by x, n) - 1 as pos, count(*) over (partition by source_id) as c from ev)
select source_id, count(*) as count, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_pop(x), 6) as std, min(x) as low, max(x) as high, max(x) filter (where pos = least(c - 1, floor(c * 0.95))) as p95 from o group by 1"""
)
def summary_stats(spark, sf_dir):
    s = stats.summary(events(spark, sf_dir))
    return s.select("source_id", "count", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"), "low", "high", "p95")


@query(f"with {EV}, c as (select source_id, max(n) + 1 as total from ev group by 1) select source_id, n, x as y from ev where n >= 149 union all select ev.source_id, total, x from ev join c on ev.source_id = c.source_id and n = total - 1")
def peaks_line_end(spark, sf_dir):
    """A viewport that reaches beyond the ends: each has its last sample once more."""
    chunks = chunked(events(spark, sf_dir), 500)
    return peaks.line(exploded(chunks), 150.0, 1e7, 800, 1.0, lengths(chunks)).select("source_id", "n", "y")


_DAY = "date_diff('day', date '1990-01-01', o_orderdate::date)"
_RANGES = f"rg as (select o_custkey as k, {_DAY}::double as s, ({_DAY} + o_orderkey % 60)::double as e from orders)"
_ISLANDS = f"""{_RANGES}, a as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as before from rg where e > s),
b as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as g from a), isl as (select k, min(s) as s, max(e) as e from b group by k, g)"""


def _ranges(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), day.cast("double").alias("start"), (day + F.col("o_orderkey") % 60).cast("double").alias("end"))


@query(f'with {_ISLANDS} select k as key, s as start, e as "end" from isl')
def merge_intervals(spark, sf_dir):
    """Days have a natural block, a year; ``range_covered`` lets quantiles choose."""
    return intervals.merged(_ranges(spark, sf_dir), "key", F.floor(F.col("start") / 365))


@query(
    f"""with {_ISLANDS}, w as (select o_orderkey, o_custkey as k, ({_DAY} + 5)::double as s, ({_DAY} + 15)::double as e from orders)
select w.k as key, w.s as start, w.e as "end", exists(select 1 from isl where isl.k = w.k and isl.s <= w.s and isl.e >= w.e) as covered from w"""
)
def range_covered(spark, sf_dir):
    ranges = _ranges(spark, sf_dir)
    wanted = ranges.select("key", (F.col("start") + 5).alias("start"), (F.col("start") + 15).alias("end"))
    return intervals.covered(wanted, intervals.merged(ranges, "key"), "key")
