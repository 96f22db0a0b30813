"""Pieces that come out of order, with a bound on how many may wait."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence


def in_order(waiting: dict[int, Sequence], frontier: int, most: int, lost: Callable[[int], None] | None = None) -> Iterator[tuple[int, Sequence]]:
    """(frontier, piece) of what has become contiguous; used pieces leave ``waiting``.

    A piece that overlaps what is done gives its rest. If more than ``most`` elements wait
    for a missing piece, that is given up: ``lost`` is told where the stream goes on, and the
    missing piece counts as too late if it still comes. So no more than ``most`` elements and
    the newest piece are ever held.
    """
    while waiting:
        first = min(waiting)
        if first > frontier:
            if lost is None or sum(map(len, waiting.values())) <= most:
                return
            lost(first)
            frontier = first
        piece = waiting.pop(first)[frontier - first :]
        if len(piece):
            yield frontier, piece
            frontier += len(piece)
