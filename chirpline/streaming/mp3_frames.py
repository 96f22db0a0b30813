"""Frames of MP3 files that arrive as pieces of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chirpline.sources.mp3 import frame_header, next_frame, tag_size
from chirpline.streaming.waiting import in_order
from chirpline.workers import prepare_workers

STATE = "done long, held binary, skip long, frames long, early_at array<long>, early array<binary>"
OUT = "source_id string, frame_idx long, at long, length int"


def cut_frames(held: bytes, first: int, skip: int, start: bool) -> tuple[list[tuple[int, int]], int, int]:
    """Whole frames in bytes that begin at offset ``first`` of the file: (at, length) of each,
    how many bytes are used up, and how many of those to come belong to no frame.

    A frame is expected at the start of a file, after its tag and after another frame; where
    there is none, the next that another follows is taken.
    """
    found, at = [], 0
    if start:
        if len(held) < 10:
            return found, 0, 0
        skip = tag_size(held)
    while True:
        if skip:
            step = min(skip, len(held) - at)
            at, skip = at + step, skip - step
        if len(held) - at < 4:
            return found, at, skip
        h = frame_header(held, at)
        if h is None or h.length <= 4:
            again = next_frame(held[: len(held)], at + 1)
            if again is None:
                return found, max(at, len(held) - 3), skip
            at = again
        elif len(held) - at < h.length:
            return found, at, skip
        else:
            found.append((first + at, h.length))
            at += h.length


#: Bytes of a file that may wait for a missing piece.
WAITING = 1 << 22
#: In place of bytes to skip: the next frame is to be found, as one that another follows.
BEHIND_GAP = -2


def stream_frames(pieces: DataFrame, most_waiting: int = WAITING) -> DataFrame:
    """(source_id, frame_idx, at, length) from a stream of (source_id, at, bytes), each frame
    once its bytes are there.

    State holds less than a frame of bytes, the rest of a tag to skip as a number, and
    pieces that came before their predecessors. Pieces may be sent again. If more than
    ``most_waiting`` bytes wait for a missing piece, it counts as lost; frames are found again
    behind it, and their numbers go on without those that were lost.
    """
    prepare_workers(pieces.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held, skip, count, early = 0, b"", -1, 0, {}
        if state.exists:
            done, held, skip, count, places, parts = state.get
            held, early = bytes(held), {p: bytes(b) for p, b in zip(places, parts)}
        for b in batches:
            for at, raw in zip(b["at"], b["bytes"]):
                if len(raw) > len(early.get(int(at), b"")):
                    early[int(at)] = bytes(raw)
        found = []

        def flush():
            nonlocal held, skip
            if skip == BEHIND_GAP:
                if (at := next_frame(held, 0)) is None:
                    return
                held, skip = held[at:], 0
            more, used, rest = cut_frames(held, done - len(held), max(0, skip), skip < 0)
            found.extend(more)
            if skip >= 0 or len(held) >= 10:  # the tag has been read
                held, skip = held[used:], rest

        def lost(on: int):
            nonlocal held, done, skip
            flush()
            # of a tag that reaches over the gap the rest is still skipped
            held, skip, done = b"", skip - (on - done) if skip > on - done else BEHIND_GAP, on

        for _, fresh in in_order(early, done, most_waiting, lost):
            held, done = held + fresh, done + len(fresh)
        flush()
        state.update((done, held, skip, count + len(found), list(early), list(early.values())))
        if found:
            yield pd.DataFrame({"source_id": key[0], "frame_idx": range(count, count + len(found)), "at": [a for a, _ in found], "length": [n for _, n in found]})

    return pieces.groupBy("source_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
