"""Streams that end, with the same rows as SQL over the tables that they were cut from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators.stft import by_bin
from chirpline.queries.files import mp3_files, wav_files
from chirpline.queries.registry import EV, SQL, events, query, r, table
from chirpline.sources.signals import chunked, exploded
from chirpline.streaming.incremental import stream_stft
from chirpline.streaming.mp3_frames import stream_frames
from chirpline.streaming.pending_reads import answered, frontiers, log_of, read_many
from chirpline.streaming.wav_bytes import stream_samples
from chirpline.workers import shared_folder

STREAM = Stft(32, 32, 16)


def streamed(pieces: DataFrame, deal: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows written as files by a hash of a column, so in no order, and read two at a time."""
    spark = pieces.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    pieces.repartition(6, deal).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    work(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(
    f"""with {EV}, c as (select source_id, max(n) + 1 as total from ev group by 1), f as (
  select e.source_id, k as frame_idx, e.n - k * 16 as i, x * (0.5 - 0.5 * cos(2 * pi() * (e.n - k * 16) / 31)) as v
  from ev e join c on e.source_id = c.source_id, unnest(range(greatest(0, ceil((e.n - 31) / 16.0)::bigint), floor(e.n / 16.0)::bigint + 1)) u(k)
  where k < greatest(0, floor((total - 32) / 16.0) + 1))
select source_id, frame_idx, b as bin, round(sqrt(pow(sum(v * cos(2 * pi() * b * i / 32)), 2) + pow(sum(v * sin(2 * pi() * b * i / 32)), 2)) / 32, 5) as mag
from f, range(16) g(b) group by all"""
)
def stream_stft_events(spark, sf_dir):
    """Spectra of the event signals, sent as a stream of chunks out of order."""
    frames = streamed(chunked(events(spark, sf_dir), 100), "n0", lambda s: stream_stft(s, STREAM))
    return by_bin(frames.withColumn("channel", F.lit(0))).select("source_id", "frame_idx", "bin", r("mag", 5).alias("mag"))


def _pieces(files: DataFrame, size: int) -> DataFrame:
    """(source_id, at, bytes) of files (path, content)."""
    starts = F.sequence(F.lit(0), F.length("content") - 1, F.lit(size))
    piece = lambda a: F.struct(a.cast("long").alias("at"), F.substring(F.col("content"), a + 1, F.lit(size)).alias("bytes"))
    return files.select(F.col("path").alias("source_id"), F.explode(F.transform(starts, piece)).alias("p")).select("source_id", "p.at", "p.bytes")


@query(SQL["wav_samples"])
def stream_wav_samples(spark, sf_dir):
    """Samples of files that arrive in pieces of 50 bytes, out of order."""
    back = exploded(streamed(_pieces(wav_files(spark, sf_dir), 50), "at", stream_samples))
    return back.select(F.col("source_id").cast("long").alias("vec_id"), "n", "x")


@query(SQL["mp3_frames"])
def stream_mp3_frames(spark, sf_dir):
    """Frames of files that arrive in pieces of 300 bytes, out of order."""
    found = streamed(_pieces(mp3_files(spark, sf_dir), 300), "at", stream_frames)
    return found.select(F.col("source_id").cast("long").alias("c_custkey"), "frame_idx", "at", "length")


PIECE = 50
#: This piece never comes in signals whose name has an even number of letters.
LOST = 2
_HOLED = "length(source_id) % 2 = 0"


def _at(seconds):
    return F.timestamp_seconds(1_000_000 + seconds)


def _reads_log(spark, sf_dir):
    """Pieces of the event signals, their lengths (but for one signal), and a read of its own signal
    for every third event."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), "event_id")
    ends = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("end")).withColumn("at", _at(F.lit(0)))
    pieces = ends.select("source_id", F.col("end").alias("total"), F.explode(F.sequence(F.lit(0), F.col("end") - 1, F.lit(PIECE))).alias("start"), "at")
    pieces = pieces.where(f"not ({_HOLED} and start = {LOST * PIECE})").select("source_id", "start", F.least(F.col("start") + PIECE, F.col("total")).alias("end"), "at")
    start = (F.col("event_id") * 7) % 2500
    reads = rows.where("event_id % 3 = 0").select("source_id", F.col("event_id").alias("request_id"), start.alias("start"), (start + F.col("event_id") % 300).alias("end"), _at(F.col("event_id") % 1000).alias("at"))
    return pieces, reads, ends.where("source_id <> 'view'")


def _answers(spark, sf_dir):
    """Reads before, among and after the pieces; then one late row of another signal moves
    the watermark beyond all deadlines."""
    pieces, reads, ends = _reads_log(spark, sf_dir)
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    none = lambda df: df.where("false")
    part = lambda k: reads.where(F.col("request_id") % 9 == 3 * k)
    late = spark.createDataFrame([("~", 0, 0)], "source_id string, start long, end long").withColumn("at", _at(F.lit(20_000)))
    for log in (log_of(none(pieces), part(0), none(ends)), log_of(pieces, part(1), ends).repartition(6, "start"), log_of(none(pieces), part(2), none(ends)), log_of(late, none(reads), none(ends))):
        log.coalesce(6).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    answered(stream, 600, "2 hours").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


_READS = f"""t as (select event_type as source_id, count(*) as total, length(event_type) % 2 = 0 as holed, event_type <> 'view' as ended from events group by 1),
q as (select event_id as request_id, event_type as source_id, (event_id * 7) % 2500 as s, (event_id * 7) % 2500 + event_id % 300 as e from events where event_id % 3 = 0),
w as (select *, case when ended and e > s then least(e, total) else e end as there from q join t using (source_id)),
a as (select *, there <= s or there <= total and (not holed or there <= {LOST * PIECE} or s >= {(LOST + 1) * PIECE}) as covered from w),
answers as (select request_id, source_id, case when not covered then 'expired' when there = e then 'full' else 'partial' end as status, s::bigint as "start", (case when covered then greatest(s, there) else e end)::bigint as "end" from a)"""


@query(f"with {_READS} select * from answers")
def stream_pending_reads(spark, sf_dir):
    """How each read ended."""
    return _answers(spark, sf_dir).where("request_id is not null").select("request_id", "source_id", "status", "start", "end")


@query(f"with {_READS} select source_id, case when holed then {LOST * PIECE} else total end::bigint as frontier from t")
def stream_frontier(spark, sf_dir):
    """How far each signal reached without a gap."""
    return frontiers(_answers(spark, sf_dir))


@query(f"with {EV}, {_READS} select request_id, status, count(*) as samples, round(sum(x), 4) as total from answers a join ev on ev.source_id = a.source_id and n >= a.start and n < a.end where status <> 'expired' group by 1, 2")
def stream_pending_samples(spark, sf_dir):
    """The samples of all answered reads."""
    found = read_many(chunked(events(spark, sf_dir), 64), _answers(spark, sf_dir).where("status in ('full', 'partial')"), 64)
    return found.groupBy("request_id", "status").agg(F.count(F.lit(1)).alias("samples"), r(F.sum("x"), 4).alias("total"))
