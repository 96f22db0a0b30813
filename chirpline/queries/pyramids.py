"""Envelopes at several zooms from one stored pyramid."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.operators.pyramid import Pyramid, bucket_ranges
from chirpline.queries.registry import EV, events, query, table
from chirpline.sources.signals import chunked, lengths
from chirpline.workers import removed_at_exit, shared_folder

#: Start, end and width of three views: buckets of 2.5, 37.3 and 211.7 samples.
ZOOMS = ((100.0, 600.0, 200), (0.0, 1865.0, 50), (40.0, 3215.5, 15))


def built(spark, sf_dir, base=16, fan=4):
    chunks = chunked(events(spark, sf_dir), 100)
    pyramid = Pyramid(spark, removed_at_exit(f"{shared_folder(spark)}/pyramid-{uuid.uuid4().hex}"), base, fan)
    return chunks, pyramid, pyramid.build(chunks)


def _buckets(zoom):
    start, end, width = zoom
    dt = (end - start) / width
    first, last = max(0, math.floor((start - dt) / dt)), math.ceil((end + dt) / dt)
    return f"select {width} as width, k, floor(k * {dt!r}::double + 0.5)::bigint as a, floor((k + 1) * {dt!r}::double + 0.5)::bigint as b from range({first}, {last + 1}) t(k)"


@query(f"with {EV}, w as ({' union all '.join(map(_buckets, ZOOMS))}) select source_id, width, k, min(x) as low, max(x) as high from w join ev on n >= a and n < b group by all")
def pyramid_envelopes(spark, sf_dir):
    """Three zooms whose buckets don't nest."""
    chunks, pyramid, levels = built(spark, sf_dir)
    sizes = lengths(chunks)
    wanted = reduce(DataFrame.unionByName, (bucket_ranges(sizes, *zoom, 1.0).withColumn("width", F.lit(zoom[2])) for zoom in ZOOMS))
    return pyramid.extremes(wanted, levels).select("source_id", "width", "k", "low", "high")


@query(
    f"""with {EV}, q as (select o_orderkey, (list_sort((select list(distinct event_type) from events)))[o_orderkey % 5 + 1] as source_id, (o_custkey * 13) % 1500 as a, (o_custkey * 13) % 1500 + (o_orderkey * 7) % 1200 as b from orders)
select o_orderkey, min(x) as low, max(x) as high from q join ev on ev.source_id = q.source_id and n >= a and n < b group by 1"""
)
def pyramid_ranges(spark, sf_dir):
    """The extremes of an arbitrary range of a signal for each order."""
    chunks, pyramid, levels = built(spark, sf_dir)
    names = F.array(*[F.lit(row["source_id"]) for row in lengths(chunks).select("source_id").distinct().orderBy("source_id").collect()])
    key = F.col("o_orderkey")
    start = (F.col("o_custkey") * 13) % 1500
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (key % 5).cast("int")).alias("source_id"), F.lit(0).alias("channel"), start.alias("a"), (start + (key * 7) % 1200).alias("b"))
    return pyramid.extremes(asked, levels).select("o_orderkey", "low", "high")
