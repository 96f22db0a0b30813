"""A table as one long file: written by many tasks, read by range, followed while it grows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chirpline.queries.registry import query, table
from chirpline.sources.signals import chunked, exploded, ordered_signal
from chirpline.sources.wav_source import interleaved, register
from chirpline.workers import removed_at_exit, shared_folder

CHUNK = 500


def _samples(spark, sf_dir, value):
    """``lineitem`` in its order as one signal."""
    rows = table(spark, sf_dir, "lineitem")
    return ordered_signal(rows, F.lit("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], value, F.floor(F.col("l_orderkey") / 500))


def _stereo(spark, sf_dir):
    """Chunks of two channels."""
    quantity, discount = (_samples(spark, sf_dir, F.col(c).cast("double") / by) for c, by in (("l_quantity", 64), ("l_discount", -1)))
    return chunked(quantity.unionByName(discount.withColumn("channel", F.lit(1))), CHUNK)


def _folder(spark):
    return removed_at_exit(f"{shared_folder(spark)}/wav-{uuid.uuid4().hex}").removeprefix("file://")


def _write(rows, folder, channels):
    rows.write.format("chirpline_wav").mode("append").option("rate", 100).option("channels", channels).save(folder)
    return folder


def _read(spark, folder):
    return spark.read.format("chirpline_wav").option("chunk", 250).option("split", 4096).load(f"{folder}/*.wav")


_ORDERED = "ev as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as n, l_quantity::double / 64 as q, -l_discount::double as d from lineitem)"
_SIXTEEN = "floor(v * case when v < 0 then 32768 else 32767 end + 0.5) / 32768"


@query(f"with {_ORDERED} select n, {_SIXTEEN.replace('v', 'q')} as x from ev where n >= 1000 and n < 3000")
def wav_long_range(spark, sf_dir):
    """Twenty seconds of one file that many tasks wrote; only their bytes are read."""
    register(spark)
    chunks = chunked(_samples(spark, sf_dir, F.col("l_quantity").cast("double") / 64), CHUNK)
    folder = _write(chunks.select("source_id", "n0", F.array("x").alias("xs")), _folder(spark), 1)
    return exploded(_read(spark, folder).where("n0 >= 1000 and n0 < 3000")).select("n", "x")


@query(f"with {_ORDERED} select n, {_SIXTEEN.replace('v', 'd')} as x from ev")
def wav_second_channel(spark, sf_dir):
    """One of two interleaved channels, whole."""
    register(spark)
    folder = _write(interleaved(_stereo(spark, sf_dir)), _folder(spark), 2)
    return exploded(_read(spark, folder).where("channel = 1")).select("n", "x")


@query(f"with {_ORDERED} select n, {_SIXTEEN.replace('v', 'q')} as x from ev")
def stream_growing_file(spark, sf_dir):
    """A stream over a file that has two thirds of its samples, and again once it has all."""
    register(spark)
    chunks = chunked(_samples(spark, sf_dir, F.col("l_quantity").cast("double") / 64), CHUNK).select("source_id", "n0", F.array("x").alias("xs"))
    total = table(spark, sf_dir, "lineitem").count()
    folder, state = _folder(spark), _folder(spark)
    for rows in (chunks.where(F.col("n0") < total * 2 // 3), chunks):
        _write(rows, folder, 1)
        stream = spark.readStream.format("chirpline_wav").option("chunk", 300).load(f"{folder}/*.wav")
        stream.writeStream.format("parquet").option("path", f"{state}/out").option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    return exploded(spark.read.parquet(f"{state}/out")).select("n", "x")
