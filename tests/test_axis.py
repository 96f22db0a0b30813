"""Ticks of axes that differ by row."""

import pytest
from pyspark.sql import functions as F

from chirpline.functions import axis


def ticks(spark, scale, *axes, spacing=45):
    rows = spark.createDataFrame([(float(a), float(b), float(h)) for a, b, h in axes], "low double, high double, height double")
    major, minor = axis.frequency_ticks(F.col("low"), F.col("high"), F.col("height"), scale, spacing)
    return [(r["major"], r["minor"]) for r in rows.select(major.alias("major"), minor.alias("minor")).collect()]


def test_linear_ticks(spark):
    (a, b, c) = ticks(spark, "linear", (0, 1000, 450), (-50, 24000, 600), (990, 990, 0))
    assert a[0] == [100.0 * k for k in range(11)] and a[1] == [20.0 * k for k in range(51)]
    assert b[0] == [2000.0 * k for k in range(13)] and c[0] == [990.0, 991.0]
    assert c[1] == sorted(c[1]) and set(c[1]) == {990.0, 991.0} and len(c[1]) > 2


@pytest.mark.parametrize("height", [60, 300, 900, 3000])
def test_log_ticks_keep_apart(spark, height):
    import math

    ((major, minor),) = ticks(spark, "log", (20, 20000, height))
    assert major[0] == 20 and set(major).isdisjoint(minor) and set(minor) | set(major) == {m * 10.0**e for e in range(1, 5) for m in range(1, 10) if 20 <= m * 10.0**e <= 20000}
    y = [(1 - (math.log10(f) - math.log10(20)) / 3) * height for f in major]
    assert all(a - b >= 33.75 for a, b in zip(y, y[1:]))
    skipped = [f for f in (20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000) if f not in major]
    assert all(min(abs((1 - (math.log10(f) - math.log10(20)) / 3) * height - v) for v in y) < 33.75 for f in skipped)


def test_mel_ticks(spark):
    small, large, none = ticks(spark, "mel", (0, 24000, 10), (0, 24000, 5000), (24001, 25000, 500))
    assert small == ([0.0], []) and large[0] == [float(f) for f in axis.MEL_TICKS] and none == ([], [])
    assert len(ticks(spark, "mel", (0, 24000, 400), spacing=90)[0][0]) < len(ticks(spark, "mel", (0, 24000, 400))[0][0])


@pytest.mark.parametrize(("step", "parts"), [(0.0001, 5), (0.0002, 5), (0.001, 5), (0.002, 4), (0.2, 4), (2.0, 4), (15.0, 5), (30.0, 5), (60.0, 5), (120.0, 5), (300.0, 5), (1800.0, 6), (3600.0, 6), (7200.0, 5), (86400.0, 5)])
def test_minor_parts(spark, step, parts):
    assert spark.range(1).select(axis.minor_parts(F.lit(step))).first()[0] == parts


def test_labels_of_all_styles(spark):
    label = lambda s, step, style: spark.range(1).select(axis.time_label(F.lit(float(s)), F.lit(float(step)), style)).first()[0]
    assert label(3661.5, 0.5, "timecode") == "01:01:01.500" and label(-61, 1, "hhmmss") == "-00:01:01"
    assert label(12.34, 0.01, "seconds") == "12.34s" and label(12, 5, "seconds") == "12s"
    assert label(7, 1, lambda c: F.concat(F.lit("t"), c.cast("int").cast("string"))) == "t7"
    hz = lambda f, style: spark.range(1).select(axis.frequency_label(F.lit(float(f)), style)).first()[0]
    assert hz(1234.4, "hz") == "1234 Hz" and hz(1234.4, "khz") == "1.23 kHz" and hz(2000, "auto") == "2 kHz"


def test_fixed_text_is_that_of_printf(spark):
    """Ties of doubles go to even, and what only looks like a tie to the nearer side."""
    import random

    rng = random.Random(1)
    values = [0.0, 0.25, 0.125, 0.375, 36.305, 1.005, 2.5, 3.5, 0.5, 1.5, 0.99995, 9.9999, 59.9995, 0.05, 0.15, 2.0**-16, 5e-324, 4503599627370497.5]
    values += [k / 2**n for n in (1, 2, 3, 4, 5, 14, 20) for k in rng.sample(range(2**20), 30)]
    values += [rng.uniform(0, 10.0**e) for e in range(-6, 8) for _ in range(30)] + [(2 * rng.randrange(10**6) + 1) / (2 * 10**d) for d in range(5) for _ in range(60)]
    rows = spark.createDataFrame([(x, d) for x in values for d in range(5)], "x double, d int")
    wrong = [(r["x"], r["d"], r["t"]) for r in rows.select("x", "d", axis.fixed(F.col("x"), F.col("d")).alias("t")).collect() if r["t"] != f"{r['x']:.{r['d']}f}"]
    assert not wrong


def test_labels_round_as_sql(spark):
    label = lambda s, step: spark.range(1).select(axis.time_label(F.lit(s), F.lit(step))).first()[0]
    assert label(-1318.625, 0.01) == "-21:58.62" and label(-1267.25, 0.5) == "-21:07.2" and label(-36.305, 0.01) == "-36.30s"
    hz = lambda f, style: spark.range(1).select(axis.frequency_label(F.lit(f), style)).first()[0]
    assert hz(1250.0, "auto") == "1.2 kHz" and hz(1125.0, "khz") == "1.12 kHz"
