"""Envelopes from stored levels: any ranges, and how few samples they read."""

import random

import pytest
from pyspark.sql import functions as F

from chirpline.operators import peaks
from chirpline.operators.pyramid import Pyramid, bucket_ranges
from chirpline.sources.signals import chunked, exploded, lengths


def signal(spark, sizes, chunk=13):
    rng = random.Random(2)
    values = {str(s): [round(rng.uniform(-1, 1), 6) for _ in range(n)] for s, n in enumerate(sizes)}
    rows = [(s, 0, n, x) for s, xs in values.items() for n, x in enumerate(xs)]
    return values, chunked(spark.createDataFrame(rows, "source_id string, channel int, n long, x double"), chunk)


@pytest.mark.parametrize(("base", "fan"), [(8, 2), (8, 4), (1, 3), (64, 8), (1000, 2)])
def test_extremes_of_any_range(spark, tmp_path, base, fan):
    values, chunks = signal(spark, [700, 1, 64, 129])
    pyramid = Pyramid(spark, str(tmp_path), base, fan)
    levels = pyramid.build(chunks)
    rng = random.Random(base)
    asked = [(i, str(rng.randrange(5)), a := rng.randrange(750), a + rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 65, 300, 720])) for i in range(300)]
    ranges = spark.createDataFrame(asked, "id int, source_id string, a long, b long").withColumn("channel", F.lit(0))
    got = sorted((r["id"], r["low"], r["high"]) for r in pyramid.extremes(ranges, levels).collect())
    want = [(i, min(x), max(x)) for i, s, a, b in asked if (x := values.get(s, [])[a:b])]
    assert got == sorted(want)


def test_envelope_from_the_pyramid_equals_the_direct_one(spark, tmp_path):
    _, chunks = signal(spark, [3000, 2500])
    pyramid = Pyramid(spark, str(tmp_path), 16, 4)
    levels = pyramid.build(chunks)
    for start, end, width in ((0.0, 3000.0, 7), (100.5, 900.25, 33), (10.0, 40.0, 60)):
        ranges = bucket_ranges(lengths(chunks), start, end, width, 1.0)
        got = sorted((r["source_id"], r["k"], r["low"], r["high"]) for r in pyramid.extremes(ranges, levels).collect())
        want = sorted((r["source_id"], r["k"], r["low"], r["high"]) for r in peaks.envelope(exploded(chunks), start, end, width, 1.0).collect())
        assert got == want


def test_samples_are_read_at_the_ends_only(spark, tmp_path):
    _, chunks = signal(spark, [20_000], 500)
    pyramid = Pyramid(spark, str(tmp_path), 16, 4)
    levels = pyramid.build(chunks)
    assert levels == 6 and pyramid.nodes().where(f"level = {levels - 1}").count() == 2
    ranges = bucket_ranges(lengths(chunks), 0.0, 20_000.0, 11, 1.0)
    nodes, ends = pyramid.parts(F.col("a"), F.col("b"), levels)
    rows = ranges.select((F.col("b") - F.col("a")).alias("n"), F.size(nodes).alias("nodes"), F.aggregate(ends, F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["start"]).alias("raw")).collect()
    assert all(r["raw"] <= 2 * 15 and r["nodes"] <= 2 * 3 * levels for r in rows) and sum(r["n"] for r in rows) == 20_000
    plan = pyramid.extremes(ranges, levels)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_signals(spark, tmp_path):
    _, chunks = signal(spark, [10])
    none = chunks.where("false")
    pyramid = Pyramid(spark, str(tmp_path), 4, 2)
    levels = pyramid.build(none)
    assert levels == 1 and pyramid.extremes(spark.createDataFrame([("0", 0, 0, 5)], "source_id string, channel int, a long, b long"), levels).count() == 0
    with pytest.raises(ValueError):
        Pyramid(spark, str(tmp_path), 4, 1)
