"""Arrays with rates of all kinds, and a read of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.queries.registry import query, r, table
from chirpline.sources import arrays

_RATE = "case vec_id % 6 when 0 then 0.0 when 1 then -8.0 when 2 then 'nan'::double when 3 then 'inf'::double when 4 then 64.0 else 16.0 + vec_id % 5 end::double"
_BAD = "case vec_id % 6 when 0 then '0.0' when 1 then '-8.0' when 2 then 'NaN' when 3 then 'Infinity' end"


def _sources(spark, sf_dir):
    key = F.col("vec_id")
    rate = F.when(key % 6 == 0, 0.0).when(key % 6 == 1, -8.0).when(key % 6 == 2, float("nan")).when(key % 6 == 3, float("inf")).when(key % 6 == 4, 64.0).otherwise(16.0 + key % 5)
    return arrays.array_sources(table(spark, sf_dir, "embeddings"), key, F.array("embedding", F.reverse("embedding")), rate)


@query(
    f"""with s as (select vec_id, {_RATE} as rate, {_BAD} as bad from embeddings)
select vec_id, case when bad is null then rate end as rate, case when bad is null then 2 end::int as channel_count, case when bad is null then 64 / rate end as duration, case when bad is not null then concat('invalid sample rate: ', bad) end as error from s"""
)
def array_checks(spark, sf_dir):
    """Which arrays pass the checks of a source."""
    found = _sources(spark, sf_dir)
    return found.select(F.col("source_id").cast("long").alias("vec_id"), F.when(F.col("error").isNull(), F.col("rate")).alias("rate"), "channel_count", "duration", "error")


@query(
    f"""with s as (select vec_id, embedding as e, {_RATE} as rate, {_BAD} as bad, vec_id % 4 - 1 as channel, (vec_id % 11) / 10.0::double - 0.1 as t0, (vec_id % 11) / 10.0::double - 0.1 + (vec_id % 7) * 0.6 as t1 from embeddings),
e as (select *, case when bad is not null then concat('invalid sample rate: ', bad) when channel not in (0, 1) then concat('invalid channel ', channel) end as error from s),
f as (select *, case when error is null then greatest(0, floor(t0 * rate + 1e-6)) end::bigint as first from e), w as (select *, case when error is null then greatest(first, ceil(t1 * rate - 1e-6)) end::bigint as wanted from f),
l as (select *, case when error is null then greatest(first, least(wanted, 64)) end::bigint as last from w)
select vec_id, first, last, wanted, case when error is null then round(coalesce(list_sum(list_transform((case when channel = 0 then e else list_reverse(e) end)[first + 1:last], lambda v: v::double)), 0), 6) end as total, error from l"""
)
def array_reads(spark, sf_dir):
    """A time range of one channel of each array; some begin before 0, end after the array, are
    empty or ask for a channel that isn't there."""
    key = F.col("vec_id")
    start = (key % 11) / 10.0 - 0.1
    asked = table(spark, sf_dir, "embeddings").select("vec_id", key.cast("string").alias("source_id"), (key % 4 - 1).cast("int").alias("channel"), start.alias("start"), (start + (key % 7) * 0.6).alias("end"))
    found = arrays.array_reads(asked, _sources(spark, sf_dir))
    return found.select("vec_id", "first", "last", "wanted", r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), "error")
