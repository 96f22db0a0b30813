"""What kind of file a row holds, by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.sources import mp3, wav


def kind_of(content: Column) -> Column:
    """'wav', 'mp3' or 'other'. MP3 files begin with a tag or with a frame that another
    follows, so that a byte-order mark isn't taken for a frame."""
    riff = (F.substring(content, 1, 4) == b"RIFF") & (F.substring(content, 9, 4) == b"WAVE")
    tagged = F.substring(content, 1, 3) == b"ID3"
    return F.when(riff, "wav").when(tagged | mp3.confirmed_start(content, F.lit(0).cast("long")), "mp3").otherwise("other")


def media_type(path: Column) -> Column:
    """MIME type by suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "mp3", "audio/mpeg").when(suffix == "ogg", "audio/ogg").when(suffix == "flac", "audio/flac").otherwise("audio/wav")


def read_audio(spark: SparkSession, pattern: str) -> DataFrame:
    """Chunks of all WAV files under a pattern, through Spark's file systems."""
    files = spark.read.format("binaryFile").load(pattern)
    return wav.chunks_of(files.where(kind_of(F.col("content")) == "wav"))
