"""Samples of WAV files that arrive as pieces of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chirpline.sources.wav import PREFIX, decode_pcm, parse_header
from chirpline.streaming.waiting import in_order
from chirpline.workers import prepare_workers

STATE = "done long, held binary, header binary, early_at array<long>, early array<binary>"
OUT = "source_id string, channel int, n0 long, x array<double>"


#: Bytes of a file that may wait for a missing piece.
WAITING = 1 << 22


def stream_samples(pieces: DataFrame, most_waiting: int = WAITING) -> DataFrame:
    """Chunks of samples from a stream of (source_id, at, bytes), ``at`` in bytes of the file.

    State holds the header until it can be read (at most PREFIX bytes, else the file is an
    error), then less than one frame of bytes that is left over, and pieces that came before
    their predecessors. Bytes before the contiguous frontier are final; pieces may be sent
    again. If more than ``most_waiting`` bytes wait for a missing piece, it counts as lost and
    samples go on behind it, with their own numbers; but a header can't be missed. The stated data
    size is trusted, since the end of a stream isn't known.
    """
    prepare_workers(pieces.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held, header, early = 0, b"", b"", {}
        if state.exists:
            done, held, header, places, parts = state.get
            held, header, early = bytes(held), bytes(header), {p: bytes(b) for p, b in zip(places, parts)}
        for b in batches:
            for at, raw in zip(b["at"], b["bytes"]):
                if len(raw) > len(early.get(int(at), b"")):
                    early[int(at)] = bytes(raw)
        info, out = parse_header(header, 1 << 62) if header else None, []

        def flush():
            nonlocal info, header, held
            if info is None and held:
                try:
                    info = parse_header(held, 1 << 62)
                    header, held = held[: info.data_at], held[info.data_at :]
                except ValueError:
                    if len(held) > PREFIX:
                        raise
            if info is None:
                return
            first = done - len(held) - info.data_at
            held = held[-first % info.align :]  # behind a gap: up to the next whole frame
            first = done - len(held) - info.data_at
            left = max(0, info.data_size - first)
            whole = min(len(held), left) // info.align * info.align
            x = decode_pcm(held[:whole], info)
            held = held[whole:] if whole < left else b""
            if whole:
                out.extend((key[0], c, first // info.align, x[:, c].astype(float)) for c in range(info.channels))

        def lost(on: int):
            nonlocal held, done
            flush()
            if info is None:
                raise ValueError(f"{key[0]}: the header is missing")
            held, done = b"", on

        for _, fresh in in_order(early, done, most_waiting, lost):
            held, done = held + fresh, done + len(fresh)
        flush()
        state.update((done, held, header, list(early), list(early.values())))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "channel", "n0", "x"])

    return pieces.groupBy("source_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
