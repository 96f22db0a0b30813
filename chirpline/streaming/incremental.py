"""Spectra of signals that arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chirpline.config import Stft
from chirpline.operators.stft import spectra
from chirpline.streaming.waiting import in_order
from chirpline.workers import prepare_workers

STATE = "frontier long, tail array<double>, waiting_n array<long>, waiting_x array<array<double>>"
OUT = "source_id string, channel int, frame_idx long, mag array<double>"


#: Samples of a signal that may wait for a missing chunk.
WAITING = 1 << 20


def stream_stft(chunks: DataFrame, cfg: Stft, most_waiting: int = WAITING) -> DataFrame:
    """Frames of a stream of chunks (source_id, channel, n0, x), each once it is complete.

    State holds the samples that coming frames still need, fewer than a window, and chunks
    that came before their predecessors. Samples up to the contiguous frontier are final:
    later copies of them are ignored, so a chunk may be sent again. If more than
    ``most_waiting`` samples wait for a missing chunk, it counts as lost: frames that need it
    are left out, and the others keep their numbers. What is left at the end is shorter than a
    window and gives no frame.
    """
    prepare_workers(chunks.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights = cfg.weights()
        frontier, tail, waiting = 0, np.empty(0), {}
        if state.exists:
            frontier, tail, ns, xs = state.get
            tail, waiting = np.array(tail, float), {n: np.array(x, float) for n, x in zip(ns, xs)}
        for b in batches:
            for n0, x in zip(b["n0"], b["x"]):
                if len(x) > len(waiting.get(n0, ())):
                    waiting[int(n0)] = np.array(x, float)
        firsts, mags = [], []

        def flush():
            nonlocal tail
            begin = frontier - len(tail)  # the next frame's first sample, or earlier
            first = -(-begin // cfg.hop)
            made = spectra(tail[first * cfg.hop - begin :], cfg, weights)
            tail = tail[min(max(0, (first + len(made)) * cfg.hop - begin), len(tail)) :]
            firsts.extend(range(first, first + len(made)))
            mags.extend(made)

        def lost(on: int):
            nonlocal tail, frontier
            flush()
            tail, frontier = np.empty(0), on

        for _, fresh in in_order(waiting, frontier, most_waiting, lost):
            tail, frontier = np.concatenate([tail, fresh]), frontier + len(fresh)
        flush()
        state.update((frontier, tail.tolist(), list(waiting), [x.tolist() for x in waiting.values()]))
        if mags:
            yield pd.DataFrame({"source_id": key[0], "channel": key[1], "frame_idx": firsts, "mag": mags})

    return chunks.groupBy("source_id", "channel").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def visible_updates(updates: DataFrame, start: float, end: float) -> DataFrame:
    """Updates (start, end) that touch the viewport; for use in ``foreachBatch``."""
    from chirpline.functions.scales import overlaps

    return updates.where(overlaps(updates["start"], updates["end"], start, end))
