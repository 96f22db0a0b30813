"""Array sources: checks, names, chunks, reads."""

import math

from pyspark.sql import functions as F

from chirpline.sources import arrays


def test_checks_and_names(spark):
    rows = [("a", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], 2.0), (None, [[1.0, 2.0]], 8.0), ("e", [], 8.0), ("n", None, 8.0), ("z", [[1.0]], 0.0), ("i", [[1.0]], math.inf), ("m", [[1.0]], -math.inf), ("q", [[1.0]], math.nan), ("u", [[1.0]], None)]
    df = spark.createDataFrame(rows, "name string, c array<array<double>>, rate double")
    got = {r["source_id"]: r for r in arrays.array_sources(df, F.col("name"), F.col("c"), F.col("rate")).collect()}
    assert (got["a"]["channel_count"], got["a"]["n_samples"], got["a"]["duration"], got["a"]["error"]) == (2, 3, 1.5, None)
    assert got["array:8:2:1"]["duration"] == 0.25 and (got["e"]["n_samples"], got["e"]["error"]) == (0, None)
    assert {k for k, r in got.items() if r["error"]} == {"n", "z", "i", "m", "q", "u"} and all(r["channels"] is None for r in got.values() if r["error"])
    mono = arrays.array_sources(df.select("name", F.get("c", 0).alias("m"), "rate"), F.col("name"), F.col("m"), F.col("rate"))
    assert {r["source_id"]: r["channel_count"] for r in mono.collect() if r["error"] is None} == {"a": 1, "array:8:2:1": 1}


def test_chunks_and_reads(spark):
    x = [float(k) for k in range(10)]
    df = spark.createDataFrame([("a", [x, x[::-1]], 2.0), ("bad", [x], 0.0), ("none", [[]], 1.0)], "name string, c array<array<double>>, rate double")
    sources = arrays.array_sources(df, F.col("name"), F.col("c"), F.col("rate"))
    chunks = {(r["source_id"], r["channel"], r["n0"]): r["x"] for r in arrays.array_chunks(sources, 4).collect()}
    assert chunks == {("a", c, n): v[n : n + 4] for c, v in ((0, x), (1, x[::-1])) for n in (0, 4, 8)}
    asked = [(1, "a", 1, 0.6, 2.2), (2, "a", 0, -3.0, 1.0), (3, "a", 0, 4.0, 99.0), (4, "a", 0, 99.0, 100.0), (5, "a", 2, 0.0, 1.0), (6, "a", None, 0.0, 1.0), (7, "bad", 0, 0.0, 1.0), (8, "?", 0, 0.0, 1.0), (9, "none", 0, 0.0, 5.0), (10, "a", 0, 2.0, 1.0), (11, "a", -1, 0.0, 1.0)]
    requests = spark.createDataFrame(asked, "id int, source_id string, channel int, start double, end double")
    got = {r["id"]: (r["first"], r["last"], r["wanted"], r["x"], r["error"]) for r in arrays.array_reads(requests, sources).collect()}
    assert got[1] == (1, 5, 5, x[::-1][1:5], None) and got[2] == (0, 2, 2, x[:2], None)
    assert got[3] == (8, 10, 198, x[8:], None) and got[4] == (198, 198, 200, [], None)
    assert got[9] == (0, 0, 5, [], None) and got[10] == (4, 4, 4, [], None)
    assert [got[k][4] for k in (5, 6, 7, 8, 11)] == ["invalid channel 2", "invalid channel null", "invalid sample rate: 0.0", "no such source", "invalid channel -1"]
    assert all(got[k][:4] == (None, None, None, None) for k in (5, 6, 7, 8, 11))


def test_ranks_of_narrow_and_repeated_values(spark):
    import random

    from chirpline.operators import stats

    rng = random.Random(3)
    values = {"narrow": [1000 + rng.uniform(0, 1e-6) for _ in range(700)], "one": [5.0] * 300, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(501)], "single": [2.0]}
    df = spark.createDataFrame([(s, x) for s, xs in values.items() for x in xs], "source_id string, x double")
    got = {r["source_id"]: (r["count"], r["median"], r["p95"]) for r in stats.summary(df).collect()}
    for s, xs in values.items():
        xs = sorted(xs)
        n = len(xs)
        assert got[s] == (n, (xs[(n - 1) // 2] + xs[n // 2]) / 2, xs[min(n - 1, math.floor(n * 0.95))])


def test_lines_repeat_the_last_sample(spark):
    from chirpline.operators import peaks

    rows = [(s, 0, n, float(n)) for s, size in (("a", 10), ("b", 30)) for n in range(size)]
    samples = spark.createDataFrame(rows, "source_id string, channel int, n long, x double")
    for start, end in ((2.0, 5.0), (4.0, 9.0), (4.0, 12.0), (11.0, 20.0), (0.0, 99.0), (12.0, 13.0)):
        low, high = math.floor(start) - 1, math.ceil(end) + 1
        want = sorted([(s, n, float(n)) for s, _, n, _ in rows if low <= n <= high] + [(s, size, size - 1.0) for s, size in (("a", 10), ("b", 30)) if low <= size <= high])
        got = sorted((r["source_id"], r["n"], r["y"]) for r in peaks.line(samples, start, end, 100, 1.0).collect())
        assert got == want
