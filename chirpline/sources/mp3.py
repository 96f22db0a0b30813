"""MP3 metadata: tags, frame headers and durations. Samples need a decoder that isn't here."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kbit/s by (MPEG 1?, layer) and samples/s of MPEG 1 (fixed values of the standard).
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
PREFIX = 65_536


@dataclass(frozen=True)
class FrameHeader:
    version: float
    layer: int
    rate: int
    kbps: int
    channels: int
    samples: int
    length: int


def tag_size(raw: bytes) -> int:
    """Bytes of an ID3v2 tag at the start, with its footer."""
    if raw[:3] != b"ID3" or len(raw) < 10 or any(b & 0x80 for b in raw[6:10]):
        return 0
    size = 0
    for b in raw[6:10]:
        size = size << 7 | b
    return 10 + size + (10 if raw[5] & 0x10 else 0)


def frame_header(raw: bytes, at: int = 0) -> FrameHeader | None:
    return _header(struct.unpack_from(">I", raw, at)[0]) if len(raw) >= at + 4 else None


@lru_cache(1 << 14)
def _header(h: int) -> FrameHeader | None:
    version, layer = {3: 1.0, 2: 2.0, 0: 2.5}.get(h >> 19 & 3), {3: 1, 2: 2, 1: 3}.get(h >> 17 & 3)
    rate_at, bit_at = h >> 10 & 3, h >> 12 & 15
    if h >> 21 != 0x7FF or version is None or layer is None or rate_at == 3 or bit_at in (0, 15):
        return None
    one = version == 1.0
    kbps = BITRATES[one, layer if one else min(layer, 2)][bit_at - 1]
    rate = RATES[rate_at] >> {1.0: 0, 2.0: 1, 2.5: 2}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    pad = h >> 9 & 1
    length = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return FrameHeader(version, layer, rate, kbps, 1 if h >> 6 & 3 == 3 else 2, samples, length)


def next_frame(raw: bytes, at: int) -> int | None:
    """The next place with a frame header that another follows, or that ends the data."""
    while at + 4 <= len(raw):
        h = frame_header(raw, at)
        if h and h.length > 4:
            after = at + h.length
            other = frame_header(raw, after)
            if after + 4 > len(raw) or other and (other.version, other.layer, other.rate) == (h.version, h.layer, h.rate):
                return at
        at += 1
    return None


def is_mp3(raw: bytes) -> bool:
    return raw[:3] == b"ID3" or next_frame(raw, 0) == 0


def frame_total(raw: bytes, at: int, h: FrameHeader) -> int | None:
    """Frames by a Xing, Info or VBRI block in the first frame."""
    side = (17 if h.channels == 1 else 32) if h.version == 1.0 else (9 if h.channels == 1 else 17)
    x = at + 4 + side
    if raw[x : x + 4] in (b"Xing", b"Info") and len(raw) >= x + 12 and struct.unpack_from(">I", raw, x + 4)[0] & 1:
        return struct.unpack_from(">I", raw, x + 8)[0]
    if raw[at + 36 : at + 40] == b"VBRI" and len(raw) >= at + 54:
        return struct.unpack_from(">I", raw, at + 50)[0]
    return None


def info(raw: bytes, total: int | None = None) -> tuple[int, int, int, float] | None:
    """(rate, channels, kbps, duration) from the first bytes of a file of ``total`` bytes."""
    at = next_frame(raw, tag_size(raw))
    if at is None:
        return None
    h = frame_header(raw, at)
    frames = frame_total(raw, at, h)
    if frames:
        seconds = frames * h.samples / h.rate
    else:
        left = (total if total is not None else len(raw)) - at
        seconds = left * 8 / (h.kbps * 1000) if left > 0 else h.samples / h.rate
    return h.rate, h.channels, h.kbps, seconds


def walked(raw: bytes, at: int | None) -> Iterator[tuple[int, FrameHeader]]:
    """(offset, header) of each whole frame from a place on; what isn't a frame is skipped."""
    while at is not None and (h := frame_header(raw, at)) and at + h.length <= len(raw):
        yield at, h
        at += h.length
        if frame_header(raw, at) is None:
            at = next_frame(raw, at)


def frames_of(raw: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each whole frame."""
    return [(at, h.length) for at, h in walked(raw, next_frame(raw, tag_size(raw)))]


def _word(content: Column, at: Column) -> Column:
    """Four bytes as a number, null beyond the end."""
    return F.conv(F.hex(F.nullif(F.substring(content, at + 1, F.lit(4)), F.lit(b""))), 16, 10).cast("long")


def _bits(word: Column, low: int, count: int) -> Column:
    return F.shiftright(word, low).bitwiseAND((1 << count) - 1)


def header_columns(content: Column, at: Column) -> dict[str, Column]:
    """``frame_header`` as column expressions: version, layer, rate, kbps, channels, samples,
    length and whether the bytes are a header at all (valid)."""
    word = _word(content, at)
    kind, layer, index, rate_at = _bits(word, 19, 2), 4 - _bits(word, 17, 2), _bits(word, 12, 4), _bits(word, 10, 2)
    valid = (F.shiftright(word, 21) == 0x7FF) & (kind != 1) & (layer != 4) & ~index.isin(0, 15) & (rate_at != 3)
    one = kind == 3
    rates = F.get(F.array(*map(F.lit, RATES)), rate_at.cast("int"))
    rate = F.when(one, rates).when(kind == 2, F.shiftright(rates, 1)).otherwise(F.shiftright(rates, 2))
    kbps = F.lit(None).cast("int")
    for (first, number), table in BITRATES.items():
        rows = F.get(F.array(*map(F.lit, table)), (index - 1).cast("int"))
        kbps = F.when((one == first) & ((layer if first else F.least(layer, F.lit(2))) == number), rows).otherwise(kbps)
    samples = F.when(layer == 1, 384).when((layer == 2) | one, 1152).otherwise(576)
    pad, per_second = _bits(word, 9, 1), kbps * 1000
    length = F.when(layer == 1, (F.floor(12 * per_second / rate) + pad) * 4).otherwise(F.floor(samples / 8 * per_second / rate) + pad)
    columns = {"version": F.when(one, 1.0).when(kind == 2, 2.0).otherwise(2.5), "layer": layer, "rate": rate, "kbps": kbps, "channels": F.when(_bits(word, 6, 2) == 3, 1).otherwise(2), "samples": samples, "length": length}
    return {k: F.when(valid, c) for k, c in columns.items()} | {"valid": F.coalesce(valid, F.lit(False))}


def tag_bytes(content: Column) -> Column:
    """``tag_size`` as a column expression."""
    size = F.conv(F.hex(F.substring(content, 7, 4)), 16, 10).cast("long")
    parts = [_bits(size, 8 * k, 8) for k in range(4)]
    footer = F.conv(F.hex(F.substring(content, 6, 1)), 16, 10).cast("int").bitwiseAND(0x10) != 0
    whole = sum((F.shiftleft(p, 7 * k) for k, p in enumerate(parts)), F.lit(10).cast("long")) + F.when(footer, 10).otherwise(0)
    tagged = (F.substring(content, 1, 3) == b"ID3") & (F.length(content) >= 10) & (size.bitwiseAND(0x80808080) == 0)
    return F.when(tagged, whole).otherwise(F.lit(0).cast("long"))


def confirmed_start(content: Column, at: Column) -> Column:
    """A frame header at ``at`` that another of its kind follows, or whose frame ends the data."""
    h = header_columns(content, at)
    after = at + h["length"]
    other = header_columns(content, after)
    same = other["valid"] & (other["version"] == h["version"]) & (other["layer"] == h["layer"]) & (other["rate"] == h["rate"])
    return F.coalesce(h["valid"] & (h["length"] > 4) & (same | (after == F.length(content))), F.lit(False))


def _each(files: DataFrame, schema: str, work: Callable[[str, bytes, int, int], list[tuple]], head: Column) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from chirpline.workers import prepare_workers

    prepare_workers(files.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for args in zip(*(b.column(c).to_pylist() for c in ("path", "head", "tag", "length"))) for r in work(*args)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    tag = tag_bytes(F.col("content"))
    return files.select("path", tag.alias("tag"), F.length("content").cast("long").alias("length"), head.alias("head")).mapInArrow(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """(path, rate, channels, kbps, duration, error) of a ``binaryFile`` DataFrame.

    Tags are skipped, however long, before the first bytes go to Python. A file without a
    frame in them is a row with an error.
    """

    def work(path, head, tag, length):
        found = info(head, length - tag)
        return [(path, *(found or (None,) * 4), None if found else "no MP3 frame")]

    after = F.substring(F.col("content"), (tag_bytes(F.col("content")) + 1).cast("int"), F.lit(PREFIX))
    return _each(files, "path string, rate int, channels int, kbps int, duration double, error string", work, after)


def frame_rows(files: DataFrame) -> DataFrame:
    """(path, frame_idx, at, length): one row for each whole frame of each file."""

    def work(path, content, tag, length):
        return [(path, k, at, n) for k, (at, n) in enumerate(frames_of(content))]

    return _each(files, "path string, frame_idx long, at long, length int", work, F.col("content"))
