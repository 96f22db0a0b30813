"""All registered queries of the signal operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chirpline.queries import array_sources, envelopes, files, grids, lookups, mp3_seeks, pictures, planning, pyramids, registry, scalars, spectra, stores, streams, wav_files  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in dB of the short-time spectra of all embedding signals."""
    return registry.QUERIES["stft_db"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
