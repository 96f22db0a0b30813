"""Signals that are arrays of a row, with their checks, and many reads of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = ["source_id", "rate", "channel_count", "n_samples", "duration", "channels", "error"]


def rate_error(rate: Column) -> Column:
    """What is wrong with a sample rate, or null: it must be a finite number above 0."""
    r = rate.cast("double")
    bad = r.isNull() | F.isnan(r) | (r <= 0) | (r == F.lit(float("inf")))
    return F.when(bad, F.concat(F.lit("invalid sample rate: "), F.coalesce(r.cast("string"), F.lit("null"))))


def array_sources(rows: DataFrame, source: Column, channels: Column, rate: Column) -> DataFrame:
    """(source_id, rate, channel_count, n_samples, duration, channels, error) of rows whose
    ``channels`` is an array of arrays, or one array for a single channel.

    The first channel's length counts. Rows that don't pass the checks keep no samples and have
    an error; a source without a name is called after its rate and sizes.
    """
    kind = rows.select(channels.alias("c")).schema["c"].dataType.simpleString()
    planar = (channels if kind.startswith("array<array") else F.array(channels)).cast("array<array<double>>")
    made = rows.select(source.cast("string").alias("source_id"), rate.cast("double").alias("rate"), planar.alias("channels"), F.when(channels.isNull(), "no samples").alias("none"))
    made = made.withColumn("error", F.coalesce(rate_error(F.col("rate")), "none"))
    good = F.col("error").isNull()
    size = F.coalesce(F.size(F.get("channels", 0)), F.lit(0)).cast("long")
    made = made.withColumn("channel_count", F.when(good, F.size("channels"))).withColumn("n_samples", F.when(good, size)).withColumn("duration", F.when(good, size / F.col("rate")))
    name = F.concat_ws(":", F.lit("array"), F.format_string("%.0f", F.col("rate")), F.col("n_samples").cast("string"), F.col("channel_count").cast("string"))
    return made.withColumn("source_id", F.coalesce("source_id", name)).withColumn("channels", F.when(good, F.col("channels"))).select(*SOURCE)


def array_chunks(sources: DataFrame, size: int) -> DataFrame:
    """(source_id, channel, n0, x) of the good ones, in chunks of ``size`` samples."""
    each = sources.where("error is null").select("source_id", F.posexplode("channels").alias("channel", "x"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("x") - 1), F.lit(size))
    return each.where(F.size("x") > 0).select("source_id", "channel", F.inline(F.transform(starts, lambda a: F.struct(a.cast("long").alias("n0"), F.slice("x", a + 1, F.lit(size)).alias("x")))))


def sample_span(start: Column, end: Column, rate: Column) -> tuple[Column, Column]:
    """(first, wanted): samples [first, wanted) of a time range, not yet cut to any signal."""
    first = F.greatest(F.lit(0), F.floor(start * rate + 1e-6))
    return first, F.greatest(first, F.ceil(end * rate - 1e-6))


def array_reads(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """``requests`` (source_id, channel, start, end, ...) with first, last, wanted, x and error.

    x holds the samples [first, last) of the range that there are. wanted is where the range
    ends by its time, also beyond the signal: what a reader of a growing source waits for. A
    channel that the source doesn't have, or a source with an error or that isn't there, is an
    error of the read.
    """
    known = sources.select("source_id", "rate", "channel_count", "n_samples", "channels", F.col("error").alias("__error"), F.lit(True).alias("__there"))
    both = requests.join(known, "source_id", "left")
    wrong = F.when(F.col("__there").isNull(), "no such source").when(F.col("__error").isNotNull(), F.col("__error"))
    wrong = F.coalesce(wrong, F.when(~F.coalesce(F.col("channel").between(0, F.col("channel_count") - 1), F.lit(False)), F.concat(F.lit("invalid channel "), F.coalesce(F.col("channel").cast("string"), F.lit("null")))))
    first, wanted = sample_span(F.col("start"), F.col("end"), F.col("rate"))
    held = F.get("channels", F.col("channel"))
    both = both.withColumn("error", wrong).withColumn("first", F.when(wrong.isNull(), first)).withColumn("wanted", F.when(wrong.isNull(), wanted))
    last = F.greatest(F.col("first"), F.least(F.col("wanted"), F.size(held)))
    cut = F.slice(held, (F.col("first") + 1).cast("int"), (last - F.col("first")).cast("int"))
    return both.select(*requests.columns, "first", F.when(F.col("error").isNull(), last).alias("last"), "wanted", F.when(F.col("error").isNull(), cut).alias("x"), "error")
