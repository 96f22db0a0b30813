"""Where queries and their SQL are kept, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.config import WINDOW_TERMS, Stft
from chirpline.operators.lookup import frame_sizes
from chirpline.operators.stft import stft_arrays
from chirpline.sources.signals import array_signals, events_signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Samples a second of the embedding signals; events have one.
RATE = 64.0
SMALL = Stft(16, 16, 4)


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array_signals(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))


def frames(spark: SparkSession, sf_dir: str, cfg: Stft = SMALL) -> DataFrame:
    return stft_arrays(embeddings(spark, sf_dir), cfg)


def sizes(spark: SparkSession, sf_dir: str, cfg: Stft = SMALL) -> DataFrame:
    """Frames of each embedding signal, from its length."""
    return frame_sizes(embeddings(spark, sf_dir), cfg)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_signal(table(spark, sf_dir, "events"))


def r(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places)


#: The event signals as SQL.
EV = "ev as (select event_type as source_id, row_number() over (partition by event_type order by ts, event_id) - 1 as n, value::double as x from events)"


def stft_cte(cfg: Stft, samples: int = 64) -> str:
    """m(vec_id, frame_idx, bin, mag): the transform of all embeddings by its definition."""
    w = " ".join(f"{'-' if k % 2 else '+'} {a} * cos({k} * 2 * pi() * i / {max(1, cfg.window_size - 1)})" for k, a in enumerate(WINDOW_TERMS[cfg.window]))
    return f"""fr as (select vec_id, f, i, embedding[f * {cfg.hop} + i + 1]::double * (0 {w}) as v from embeddings, range({cfg.frames(samples)}) a(f), range({cfg.window_size}) b(i)),
m as (select vec_id, f as frame_idx, k as bin, sqrt(pow(sum(v * cos(2 * pi() * k * i / {cfg.fft_size})), 2) + pow(sum(v * sin(2 * pi() * k * i / {cfg.fft_size})), 2)) / {cfg.fft_size} as mag from fr, range({cfg.bins}) c(k) group by all)"""
