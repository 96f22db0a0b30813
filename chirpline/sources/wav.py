"""WAV files: header, samples by byte range as a Spark data source, and encoding."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.workers import prepare_workers

PREFIX = 4096


@dataclass(frozen=True)
class WavInfo:
    code: int
    channels: int
    rate: int
    bits: int
    align: int
    data_at: int
    data_size: int

    @property
    def frames(self) -> int:
        return self.data_size // self.align


def is_wav(raw: bytes) -> bool:
    return raw[:4] == b"RIFF" and raw[8:12] == b"WAVE"


def parse_header(raw: bytes, total: int | None = None) -> WavInfo:
    """Walk the chunks up to ``data``; integer samples of 8 to 32 bits and 32-bit floats.

    A data size beyond the file is cut to what is there.
    """
    if not is_wav(raw):
        raise ValueError("no WAV file")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            if fmt is None:
                break
            code, channels, rate, _, align, bits = fmt
            if not (code == 1 and bits in (8, 16, 24, 32) or code == 3 and bits == 32):
                raise ValueError(f"WAV format {code} of {bits} bits isn't supported")
            there = (total if total is not None else len(raw)) - at - 8
            return WavInfo(code, channels, rate, bits, align, at + 8, max(0, min(size, there)))
        at += 8 + size + size % 2
    raise ValueError("no fmt or data chunk")


def header_of(at: Callable[[int, int], bytes], total: int) -> WavInfo:
    """The header of a file that is read by (offset, size): its first bytes, then chunk by
    chunk, skipping what stands before the data."""
    head = at(0, PREFIX)
    if not is_wav(head):
        raise ValueError("no WAV file")
    place, kept = 12, head[:12]
    while place + 8 <= total:
        name = head[place : place + 8] if place + 24 <= len(head) else at(place, 8)
        if len(name) < 8:
            break
        size = struct.unpack_from("<I", name, 4)[0]
        if name[:4] == b"data":
            info = parse_header(kept + name, 1 << 62)
            return replace(info, data_at=place + 8, data_size=max(0, min(size, total - place - 8)))
        if name[:4] == b"fmt ":
            kept += name[:4] + struct.pack("<I", 16) + (head[place + 8 : place + 24] if place + 24 <= len(head) else at(place + 8, 16))
        place += 8 + size + size % 2
    raise ValueError("no fmt or data chunk")


def decode_pcm(raw: bytes, info: WavInfo) -> np.ndarray:
    """(frames, channels) in [-1, 1)."""
    raw = raw[: len(raw) // info.align * info.align]
    if info.code == 3:
        x = np.frombuffer(raw, "<f4").astype(np.float32)
    elif info.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif info.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 8388608
    else:
        x = (np.frombuffer(raw, f"<i{info.bits // 8}") / float(1 << (info.bits - 1))).astype(np.float32)
    return x.reshape(-1, info.channels)


def byte_range(info: WavInfo, start: float, end: float) -> tuple[int, int]:
    """Bytes [a, b) of a time range, on whole frames."""
    import math

    a = min(info.frames, max(0, math.floor(start * info.rate + 1e-6)))
    b = min(info.frames, max(a, math.ceil(end * info.rate - 1e-6)))
    return info.data_at + a * info.align, info.data_at + b * info.align


def encode(channels: np.ndarray, rate: int, bits: int = 16, quantizer: str = "round") -> bytes:
    """A file of (frames, channels): 16-bit integers or 32-bit floats.

    'round' scales negative values by 0x8000 and others by 0x7fff and rounds half up;
    'trunc' scales all by 32767 and cuts towards zero, and takes an array of at most eight
    rows and more columns for (channels, frames).
    """
    x = np.atleast_2d(np.asarray(channels, np.float64).T).T
    if quantizer == "trunc" and x.shape[0] <= 8 and x.shape[0] < x.shape[1]:
        x = x.T
    raw = encoded_samples(x, bits, quantizer)
    return header(len(raw), x.shape[1], rate, bits) + raw


def encoded_samples(x: np.ndarray, bits: int = 16, quantizer: str = "round") -> bytes:
    """Bytes of (frames, channels), without a header."""
    if bits == 32:
        return x.astype("<f4").tobytes()
    c = np.clip(x, -1, 1)
    scaled = np.trunc(c * 32767) if quantizer == "trunc" else np.floor(np.where(c < 0, c * 0x8000, c * 0x7FFF) + 0.5)
    return scaled.astype("<i2").tobytes()


def header(size: int, channels: int, rate: int, bits: int) -> bytes:
    """The header of a file with ``size`` bytes of samples."""
    align = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 3 if bits == 32 else 1, channels, rate, rate * align, align, bits, b"data", size)


#: Chunks that may stand before the data of a file read as a whole row.
BEFORE_DATA = 64


def _little(content: Column, at: Column) -> Column:
    """The unsigned number of four bytes at an offset from 0."""
    byte = lambda k: F.conv(F.hex(F.substring(content, (at + k + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216, F.lit(0).cast("long"))


def header_bytes(content: Column) -> Column:
    """The bytes up to the end of the data chunk's head, found by walking the chunks' sizes."""
    named = lambda at: F.substring(content, (at + 1).cast("int"), F.lit(4)) == b"data"
    step = lambda at, _: F.when(named(at) | (at > F.length(content)), at).otherwise(at + 8 + _little(content, at + 4) + _little(content, at + 4) % 2)
    at = F.aggregate(F.sequence(F.lit(1), F.lit(BEFORE_DATA)), F.lit(12).cast("long"), step)
    return F.substring(content, F.lit(1), F.least(at + 8, F.length(content)).cast("int"))


def headers(files: DataFrame) -> DataFrame:
    """(path, rate, channels, bits, n_samples, duration, error) of a ``binaryFile`` DataFrame.

    Only what stands before the samples goes to Python. A file that can't be read is a row
    with an error.
    """
    prepare_workers(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("n_samples", pa.int64()), ("duration", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, total, head in zip(*(b.column(c).to_pylist() for c in ("path", "length", "head"))):
                try:
                    i = parse_header(head, total)
                    rows.append((path, i.rate, i.channels, i.bits, i.frames, i.frames / i.rate, None))
                except (ValueError, struct.error, ZeroDivisionError) as wrong:
                    rows.append((path, None, None, None, None, None, str(wrong)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    wavs = files.where((F.substring("content", 1, 4) == b"RIFF") & (F.substring("content", 9, 4) == b"WAVE"))
    head = header_bytes(F.col("content"))
    return wavs.select("path", F.length("content").cast("long").alias("length"), head.alias("head")).mapInArrow(run, "path string, rate int, channels int, bits int, n_samples long, duration double, error string")


def chunks_of(files: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(source_id, channel, n0, x) of a ``binaryFile`` DataFrame: each file's samples in
    chunks. Files are whole rows here; ``WavSource`` splits long ones by byte range. Files
    that can't be read give none; ``headers`` says why."""
    prepare_workers(files.sparkSession)
    schema = "source_id string, channel int, n0 long, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    info = parse_header(raw)
                except (ValueError, struct.error):
                    continue
                x = decode_pcm(raw[info.data_at : info.data_at + info.data_size], info)
                out = [(path, c, n0, x[n0 : n0 + size, c].astype(np.float64)) for c in range(info.channels) for n0 in range(0, len(x), size)]
                for k in range(0, len(out), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[k : k + 16]), (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["source_id", "channel", "n0", "x"])

    return files.select("path", "content").mapInArrow(run, schema)


def encoded(signals: DataFrame, rate: int, bits: int = 16, quantizer: str = "round") -> DataFrame:
    """(source_id, content): a file for each row (source_id, x), which holds a whole signal, or
    (source_id, xs), its channels. Long signals are written by the data source, in pieces."""
    prepare_workers(signals.sparkSession)
    rows = signals if "xs" in signals.columns else signals.withColumn("xs", F.array("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode(np.array(xs).T, rate, bits, quantizer) for xs in b.column("xs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), pa.array(made, pa.binary())], names=["source_id", "content"])

    return rows.select("source_id", "xs").mapInArrow(run, "source_id string, content binary")
