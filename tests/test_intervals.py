"""Unions of ranges: hot keys, crowded times, plans without early jobs."""

import random

import pytest
from pyspark.sql import functions as F

from chirpline.operators import intervals


def plain(rows):
    out = {}
    for k, a, b in sorted(r for r in rows if r[2] > r[1]):
        mine = out.setdefault(k, [])
        if mine and a <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], b)
        else:
            mine.append([a, b])
    return sorted((k, a, b) for k, ranges in out.items() for a, b in ranges)


def cases():
    rng = random.Random(8)
    yield "mixed", [(rng.randrange(3), a := float(rng.randrange(200)), a + rng.choice([-1, 0, 0.5, 3, 40])) for _ in range(400)]
    yield "one key", [(1, a := rng.uniform(0, 1000), a + rng.expovariate(1)) for _ in range(900)]
    yield "crowded", [(1, a := rng.uniform(0, 1e-3) if k % 10 else rng.uniform(0, 1e6), a + 1e-5) for k in range(900)]
    yield "one start", [(1, 5.0, 5.0 + k % 7) for k in range(200)]
    yield "long over many", [(1, 0.0, 500.0), *[(1, float(k), k + 0.5) for k in range(1000)], (2, 3.0, 4.0)]
    yield "none", []


@pytest.mark.parametrize(("name", "rows"), list(cases()))
def test_unions_match_plain(spark, name, rows):
    ranges = spark.createDataFrame(rows, "key int, start double, end double")
    want = plain(rows)
    for block in (None, F.floor(F.col("start") / 7), F.lit(0)):
        islands = intervals.merged(ranges, "key", block)
        assert sorted(tuple(r) for r in islands.collect()) == want
    wanted = [(k, a, b) for k in (1, 2, 9) for a in (-1.0, 0.0, 5.0, 5.5, 250.0) for b in (a, a + 0.25, a + 600)]
    asked = spark.createDataFrame(wanted, "key int, start double, end double")
    got = sorted(tuple(r) for r in intervals.covered(asked, intervals.merged(ranges, "key"), "key").collect())
    assert got == sorted((k, a, b, b <= a or any(k == i and s <= a and b <= e for i, s, e in want)) for k, a, b in wanted)


def test_no_job_runs_early_and_exchanges_are_few(spark):
    ranges = spark.range(1000).select((F.col("id") % 5).alias("key"), F.col("id").cast("double").alias("start"), (F.col("id") + 2.0).alias("end"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "no job")
    islands = intervals.merged(ranges, "key")
    assert list(tracker.getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setJobGroup("other", "")
    islands.collect()
    plan = islands._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 4
