"""WAV files as a Spark data source: byte ranges in, byte ranges out, growing files as streams."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from chirpline.sources.byte_files import Bytes, listed
from chirpline.sources.wav import PREFIX, WavInfo, decode_pcm, encoded_samples, header, header_of
from chirpline.workers import prepare_workers

SCHEMA = "source_id string, channel int, n0 long, x array<double>, error string"


def register(spark: SparkSession) -> None:
    """Make the format ``chirpline_wav`` known and let filters reach it."""
    prepare_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


#: Partitions that one scan is cut into, beside one for each file.
PARTITIONS = 1024


class WavSource(DataSource):
    """``spark.read.format("chirpline_wav").load(pattern)`` and ``readStream``; ``df.write`` to a folder.

    Reading gives a row for each channel and chunk. Options: split (bytes of a file in a
    partition, default 16 MB; more where a scan would have over ``PARTITIONS`` of them), chunk (samples in a row, default 65536; rows begin at its
    multiples), start and end (seconds; only their bytes are read). Equality and lists of
    source_id and channel and bounds of n0 are pushed down to byte ranges. The driver only lists
    files; tasks read headers. A file that can't be read is one row with an error. Paths may be
    local or of any file system that Arrow can open; ``wav.chunks_of`` reads through Spark's own.

    Writing takes rows (source_id, n0, xs), xs holding the samples of each channel (see
    ``interleaved``). Options: rate, bits (16 or 32), quantizer, channels. The folder must be one
    that all executors can open for random writes. A file <source_id>.wav appears in it when all
    tasks are done: tasks write their rows' bytes to their offsets in a hidden file, so one
    long signal is written by many tasks, and a task that runs again writes the same bytes.
    """

    @classmethod
    def name(cls):
        return "chirpline_wav"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WavReader(self.options)

    def streamReader(self, schema):
        return WavStreamReader(self.options)

    def writer(self, schema, overwrite):
        return WavWriter(self.options, overwrite)


@dataclass
class Piece(InputPartition):
    """Chunks that begin in bytes [first, last) of a file of ``size`` bytes."""

    uri: str
    size: int
    first: int
    last: int


@dataclass(frozen=True)
class Wanted:
    """What filters and options leave: sources, channels, chunk starts, samples."""

    sources: frozenset | None = None
    channels: frozenset | None = None
    low: int = 0
    high: int | None = None

    def narrowed(self, f) -> Wanted | None:
        """With one filter more, or None if it isn't one of these."""
        name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if name in ("source_id", "channel") and isinstance(f, (EqualTo, In)):
            values = frozenset(f.value if isinstance(f, In) else [f.value])
            field = "sources" if name == "source_id" else "channels"
            known = getattr(self, field)
            return replace(self, **{field: values if known is None else known & values})
        if name == "n0" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low, high = self.low, self.high
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = f.value + (not isinstance(f, LessThan))
                high = bound if high is None else min(high, bound)
            return replace(self, low=low, high=high)
        return None


def _error(uri: str, message: str) -> pa.RecordBatch:
    return _batch([(uri, None, None, None, message)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["source_id", "channel", "n0", "x", "error"])


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.wanted = options, Wanted()
        self.chunk, self.split = int(options.get("chunk", 1 << 16)), int(options.get("split", 16 << 20))
        self.read_bytes = 0

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if (narrowed := self.wanted.narrowed(f)) is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self):
        files = [f for f in listed(self.options["path"]) if self.wanted.sources is None or f.uri in self.wanted.sources]
        # each partition is a task, which the driver holds and reports on, however small it is
        split = max(self.split, -(-sum(f.size for f in files) // PARTITIONS))
        return [Piece(f.uri, f.size, a, min(a + split, f.size)) for f in files for a in range(0, max(1, f.size), split)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there is no file
            return
        try:
            with Bytes(piece.uri) as raw:
                yield from self._chunks(raw, header_of(raw.at, piece.size), piece)
                self.read_bytes += raw.read_bytes
        except (ValueError, OSError, ZeroDivisionError) as wrong:
            if not piece.first and self.wanted == Wanted(sources=self.wanted.sources):
                yield _error(piece.uri, str(wrong))

    def _span(self, info: WavInfo) -> tuple[int, int]:
        """Samples of the time range that the options name."""
        low = max(0, int(float(self.options.get("start", 0)) * info.rate + 1e-6))
        high = min(info.frames, int(-(-(float(self.options["end"]) * info.rate - 1e-6) // 1))) if "end" in self.options else info.frames
        return low, high

    def _chunks(self, raw: Bytes, info: WavInfo, piece: Piece) -> Iterator[pa.RecordBatch]:
        low, high = self._span(info)
        # chunks of this piece: those whose first byte it holds
        frame = lambda at: max(0, -(-(at - info.data_at) // info.align))
        begin, stop = frame(piece.first), min(info.frames, frame(piece.last))
        channels = [c for c in range(info.channels) if self.wanted.channels is None or c in self.wanted.channels]
        first = max(low, 0) // self.chunk * self.chunk
        for at in range(max(first, -(-begin // self.chunk) * self.chunk), min(stop, high), self.chunk):
            n0, n1 = max(at, low), min(at + self.chunk, high)
            if not channels or n0 >= n1 or n0 < self.wanted.low or self.wanted.high is not None and n0 >= self.wanted.high:
                continue
            x = decode_pcm(raw.at(info.data_at + n0 * info.align, (n1 - n0) * info.align), info).astype(np.float64)
            yield _batch([(piece.uri, c, n0, x[:, c], None) for c in channels])


class WavStreamReader(DataSourceStreamReader):
    """Files that grow: an offset is how many bytes of each file have been seen.

    Whole frames are read as they come, from the bytes between two offsets; what is left of a
    frame waits for the next. A stream that starts again goes on from the offsets of its
    checkpoint. New files are found, and a file whose header isn't whole gives nothing yet.
    """

    def __init__(self, options):
        self.options, self.chunk = options, int(options.get("chunk", 1 << 16))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f.uri: f.size for f in listed(self.options["path"])}

    def partitions(self, start, end):
        return [Piece(uri, size, start.get(uri, 0), size) for uri, size in sorted(end.items()) if size > start.get(uri, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with Bytes(piece.uri) as raw:
            try:
                info = header_of(raw.at, piece.last)
            except ValueError as wrong:
                if piece.last >= PREFIX and not piece.first:
                    yield _error(piece.uri, str(wrong))
                return
            if not info.data_size:  # not known to the writer yet
                info = replace(info, data_size=piece.last - info.data_at)
            frames = lambda size: max(0, min(size, info.data_at + info.data_size) - info.data_at) // info.align
            for n0 in range(frames(piece.first), frames(piece.last), self.chunk):
                n1 = min(n0 + self.chunk, frames(piece.last))
                x = decode_pcm(raw.at(info.data_at + n0 * info.align, (n1 - n0) * info.align), info).astype(np.float64)
                yield _batch([(piece.uri, c, n0, x[:, c], None) for c in range(info.channels)])

    def commit(self, end):
        pass


def interleaved(chunks: DataFrame) -> DataFrame:
    """(source_id, n0, xs): the channels of each chunk together, as the sink takes them."""
    both = F.array_sort(F.collect_list(F.struct("channel", "x")))
    return chunks.groupBy("source_id", "n0").agg(F.transform(both, lambda s: s["x"]).alias("xs"))


@dataclass
class Written(WriterCommitMessage):
    """How many frames each file has, as far as a task has seen."""

    frames: dict[str, int]


class WavWriter(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path = options["path"].removeprefix("file://")
        self.overwrite = overwrite
        self.rate, self.bits = int(options["rate"]), int(options.get("bits", 16))
        self.channels, self.quantizer = int(options.get("channels", 1)), options.get("quantizer", "round")
        self.hidden = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        self.align = self.channels * self.bits // 8
        os.makedirs(self.hidden, exist_ok=True)

    def write(self, iterator) -> Written:
        frames: dict[str, int] = {}
        name, out = None, None
        try:
            for row in iterator:
                if row["source_id"] != name:
                    if out is not None:
                        os.close(out)
                    name = row["source_id"]
                    out = os.open(f"{self.hidden}/{name}.wav", os.O_CREAT | os.O_WRONLY, 0o644)
                x = np.array(row["xs"], np.float64).T
                if x.ndim != 2 or x.shape[1] != self.channels:
                    raise ValueError(f"{name}: {self.channels} channels of equal length are expected")
                raw, at = encoded_samples(x, self.bits, self.quantizer), len(header(0, self.channels, self.rate, self.bits)) + row["n0"] * self.align
                while raw:
                    done = os.pwrite(out, raw, at)
                    raw, at = raw[done:], at + done
                frames[name] = max(frames.get(name, 0), row["n0"] + len(x))
        finally:
            if out is not None:
                os.close(out)
        return Written(frames)

    def commit(self, messages) -> None:
        frames: dict[str, int] = {}
        for m in messages:
            for name, n in (m.frames if m else {}).items():
                frames[name] = max(frames.get(name, 0), n)
        if self.overwrite:
            for old in os.listdir(self.path):
                if old.endswith(".wav"):
                    os.unlink(f"{self.path}/{old}")
        for name, n in frames.items():
            with open(f"{self.hidden}/{name}.wav", "r+b") as f:
                f.write(header(n * self.align, self.channels, self.rate, self.bits))
                f.truncate(44 + n * self.align)
            os.replace(f"{self.hidden}/{name}.wav", f"{self.path}/{name}.wav")
        os.rmdir(self.hidden)

    def abort(self, messages) -> None:
        for name in os.listdir(self.hidden):
            os.unlink(f"{self.hidden}/{name}")
        os.rmdir(self.hidden)
