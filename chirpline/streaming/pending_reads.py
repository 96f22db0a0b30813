"""Reads of ranges that may not have arrived yet: answered once they are there, or expired."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chirpline.workers import prepare_workers

IN = "source_id string, kind string, request_id long, start long, end long, at timestamp"
OUT = "source_id string, request_id long, status string, start long, end long"


def use_state_store(spark: SparkSession) -> None:
    """Processors with several kinds of state need Spark's RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(df: DataFrame, kind: str, request: Column | None = None) -> DataFrame:
    request = F.lit(None) if request is None else request
    return df.select("source_id", F.lit(kind).alias("kind"), request.cast("long").alias("request_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "at")


def log_of(pieces: DataFrame, requests: DataFrame, ends: DataFrame) -> DataFrame:
    """One stream of three: arrived pieces (source_id, start, end, at), reads (request_id, source_id,
    start, end, at) and the lengths of signals that have ended (source_id, end, at)."""
    closing = ends.withColumn("start", F.lit(0))
    return _rows(pieces, "piece").unionByName(_rows(requests, "read", F.col("request_id"))).unionByName(_rows(closing, "end"))


def unions(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, separate ranges of any ranges; those that touch are one, empty ones go."""
    there = ends > starts
    order = np.argsort(starts[there], kind="stable")
    starts, ends = starts[there][order], np.maximum.accumulate(ends[there][order])
    apart = starts[1:] > ends[:-1]
    return starts[np.r_[True, apart]] if len(starts) else starts, ends[np.r_[apart, True]] if len(ends) else ends


def covered(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which ranges [low, high) lie in one of the sorted, separate ranges, or are empty."""
    at = np.searchsorted(starts, low, "right") - 1
    inside = high <= ends[at] if len(ends) else np.zeros(len(low), bool)
    return (high <= low) | (at >= 0) & inside


def united(islands: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """``unions`` of sorted, separate ranges and one more."""
    found = unions(*np.array([*islands, (start, end)], np.int64).T)
    return list(zip(*(part.tolist() for part in found)))


def covers(islands: list[tuple[int, int]], start: int, end: int) -> bool:
    return bool(covered(*np.array(islands, np.int64).reshape(-1, 2).T, np.array([start]), np.array([end]))[0])


#: Reads that one entry of the state holds.
BLOCK = 8192
#: A waiting read: request, start, end, deadline.
READ = 4


class Reads(StatefulProcessor):
    """State of a signal: the ranges that have arrived, its length once it has ended, and
    the reads that wait. A missing piece splits the ranges once, however long it is missing,
    and reads leave when they are answered or after ``wait_ms``; so state doesn't grow with
    the signal.

    Reads wait in blocks of packed numbers, all full but one: a batch asks the state once for
    each block, not for each read, and only blocks that lose or gain reads are written. Ranges and reads
    are compared sorted, not in pairs. One timer runs, for the earliest deadline.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getValueState("arrived", "starts array<long>, ends array<long>, length long, frontier long")
        self.waiting = handle.getMapState("waiting", "block long", "reads binary")

    def _known(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        if not self.arrived.exists():
            return np.empty(0, np.int64), np.empty(0, np.int64), -1, 0
        starts, ends, length, frontier = self.arrived.get()
        return np.array(starts, np.int64), np.array(ends, np.int64), int(length), int(frontier)

    def _blocks(self) -> dict[int, np.ndarray]:
        if not self.waiting.exists():
            return {}
        return {int(k[0]): np.frombuffer(v[0], np.int64).reshape(-1, READ) for k, v in self.waiting.iterator()}

    def _keep(self, before: dict[int, np.ndarray], stay: dict[int, np.ndarray], fresh: np.ndarray) -> None:
        """Write the reads that ``stay`` in each block and fresh ones, and set the timer."""
        changed = [k for k, block in before.items() if not stay[k].all() or len(block) < BLOCK]
        left = np.concatenate([*(before[k][stay[k]] for k in changed), fresh])
        whole = [block for k, block in before.items() if k not in changed]
        if len(fresh) or any(not stay[k].all() for k in changed):
            free = [*changed, *range(max(before, default=-1) + 1, max(before, default=-1) + 1 + -(-len(left) // BLOCK))]
            used = free[: -(-len(left) // BLOCK)]
            for n, k in enumerate(used):
                self.waiting.updateValue((k,), (left[n * BLOCK : (n + 1) * BLOCK].tobytes(),))
            for k in set(changed) - set(used):
                self.waiting.removeKey((k,))
        if deadlines := [int(block[:, 3].min()) for block in (*whole, left) if len(block)]:
            self.handle.registerTimer(min(deadlines))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts, ends, length, before = self._known()
        pieces, asked = [np.stack([starts, ends])], [np.empty((0, READ), np.int64)]
        for batch in rows:
            kind = batch["kind"].to_numpy()
            request, start, end, at = (batch[c].to_numpy(np.int64) for c in ("request_id", "start", "end", "at_ms"))
            piece, read, closing = (kind == k for k in ("piece", "read", "end"))
            pieces.append(np.stack([start[piece], end[piece]]))
            asked.append(np.stack([request[read], start[read], end[read], at[read] + self.wait_ms], 1))
            length = max(length, int(end[closing].max(initial=-1)))
        fresh, blocks = np.concatenate(asked), self._blocks()
        starts, ends = unions(*np.concatenate(pieces, 1))
        first = np.searchsorted(starts, 0, "right") - 1
        frontier = max(0, int(ends[first])) if first >= 0 else 0
        self.arrived.update((starts.tolist(), ends.tolist(), length, frontier))
        if frontier > before:
            yield pd.DataFrame({"source_id": [key[0]], "request_id": pd.array([None], "Int64"), "status": ["frontier"], "start": [0], "end": [frontier]})

        def there(reads):
            _, low, high, _ = reads.T
            return np.where(high > low, np.minimum(high, length), high) if length >= 0 else high

        def done(reads):
            return covered(starts, ends, reads[:, 1], there(reads))

        answers = {k: done(block) for k, block in blocks.items()}
        found = [blocks[k][answered] for k, answered in answers.items()] + [fresh[now := done(fresh)]]
        # a request that is asked again while it waits takes the place of the former
        late = fresh[~now][::-1]
        late = late[np.unique(late[:, 0], return_index=True)[1]]
        self._keep(blocks, {k: ~answers[k] & ~np.isin(block[:, 0], late[:, 0]) for k, block in blocks.items()}, late)
        if len(out := np.concatenate(found)):
            stop = there(out)
            yield self._told(key, out, np.where(stop == out[:, 2], "full", "partial"), np.maximum(out[:, 1], stop))

    def _told(self, key, reads: np.ndarray, status, end: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"source_id": key[0], "request_id": reads[:, 0], "status": status, "start": reads[:, 1], "end": end})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer of a read that was answered meanwhile finds nothing, or the next
        now, blocks = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1), self._blocks()
        stay = {k: block[:, 3] > now for k, block in blocks.items()}
        late = np.concatenate([np.empty((0, READ), np.int64), *(block[~stay[k]] for k, block in blocks.items())])
        self._keep(blocks, stay, np.empty((0, READ), np.int64))
        if len(late):
            yield self._told(key, late, "expired", late[:, 2])


def answered(log: DataFrame, wait_seconds: float, delay: str) -> DataFrame:
    """(source_id, request_id, status, start, end) of a stream of ``log_of``.

    'full': all of the range has arrived. 'partial': all that there is of a range that goes
    beyond the signal's end; end is cut to it. 'expired': the range isn't there ``wait_seconds``
    after it was asked for, by event time. An empty range is always full. A read that is asked for after its data is answered
    in the same batch. Rows without request_id tell how far the signal reaches from 0 without
    a gap, each time that grows. Pieces may overlap and come again.
    """
    prepare_workers(log.sparkSession)
    use_state_store(log.sparkSession)
    # no nulls and plain milliseconds, so that numbers stay whole ones and no time zone matters
    plain = log.withWatermark("at", delay).withColumn("request_id", F.coalesce("request_id", F.lit(-1))).withColumn("at_ms", F.unix_millis("at"))
    return plain.groupBy("source_id").transformWithStateInPandas(Reads(int(wait_seconds * 1000)), OUT, "Append", "EventTime")


def frontiers(answers: DataFrame) -> DataFrame:
    """(source_id, frontier): the last that was told of each signal."""
    return answers.where("status = 'frontier'").groupBy("source_id").agg(F.max("end").alias("frontier"))


def read_many(chunks: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """``ranges`` (source_id, start, end, ...) with n and x of all their samples, from chunks
    that begin at multiples of ``size``: an equality join on the chunks' starts."""
    first = F.floor(F.greatest(F.lit(0), F.col("start")) / size)
    last = F.floor((F.col("end") - 1) / size)
    asked = ranges.where(F.col("end") > F.greatest(F.lit(0), F.col("start"))).withColumn("n0", F.explode(F.transform(F.sequence(first, last), lambda k: k * size)))
    joined = asked.join(chunks.select("source_id", "n0", "x"), ["source_id", "n0"])
    low = F.greatest(F.col("start"), F.col("n0")) - F.col("n0")
    high = F.least(F.col("end"), F.col("n0") + F.size("x")) - F.col("n0")
    cut = F.slice("x", (low + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))
    return joined.select(*ranges.columns, (F.col("n0") + low).alias("__n"), F.posexplode(cut).alias("__i", "x")).select(*ranges.columns, (F.col("__n") + F.col("__i")).alias("n"), "x")
