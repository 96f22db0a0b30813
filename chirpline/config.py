"""Settings of spectra, value scales and viewports, with their checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

WINDOWS = ("rectangular", "hann", "hamming", "blackman")
#: Cosine-series weights of the window kinds (fixed values).
WINDOW_TERMS = {"rectangular": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}
MODES = ("magnitude", "power", "db")


@dataclass(frozen=True)
class Stft:
    """Short-time transform: window of ``window_size`` samples each ``hop`` samples,
    padded on the right to ``fft_size``."""

    window_size: int = 1024
    fft_size: int = 1024
    hop: int = 256
    window: str = "hann"
    tile_cells: int = 1 << 17

    def __post_init__(self):
        if self.fft_size < 2 or self.fft_size & (self.fft_size - 1):
            raise ValueError("fft_size must be a power of two of at least 2")
        if not 0 < self.window_size <= self.fft_size:
            raise ValueError("window_size must be positive and at most fft_size")
        if self.hop <= 0:
            raise ValueError("hop must be positive")
        if self.window not in WINDOWS:
            raise ValueError(f"window must be one of {', '.join(WINDOWS)}")
        if not 0 < self.tile_cells < math.inf:
            raise ValueError("tile_cells must be positive and finite")

    @property
    def bins(self) -> int:
        return self.fft_size // 2

    @property
    def frames_per_tile(self) -> int:
        return max(1, int(self.tile_cells) // max(1, self.bins))

    @property
    def tile_hop(self) -> int:
        """Samples from the start of a tile to the start of the next."""
        return self.frames_per_tile * self.hop

    @property
    def tile_span(self) -> int:
        """Samples that a whole tile reads; neighbours overlap by window_size - hop."""
        return (self.frames_per_tile - 1) * self.hop + self.window_size

    def frames(self, samples: int) -> int:
        return max(0, (samples - self.window_size) // self.hop + 1)

    def tile_seconds(self, rate: float) -> float:
        return self.tile_hop / rate

    def weights(self) -> np.ndarray:
        """The symmetric window; a window of one sample is 1."""
        n = self.window_size
        if n == 1:
            return np.ones(1)
        angle = 2 * np.pi * np.arange(n) / (n - 1)
        return sum((-1) ** k * a * np.cos(k * angle) for k, a in enumerate(WINDOW_TERMS[self.window]))


@dataclass(frozen=True)
class ValueScale:
    """Display scale. ``low`` and ``high`` are dB in every mode."""

    mode: str = "db"
    low: float = -100.0
    high: float = 0.0
    gamma: float = 1.0
    clamp: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    def bounds(self) -> tuple[float, float]:
        to = {"db": lambda d: d, "magnitude": lambda d: 10 ** (d / 20), "power": lambda d: (10 ** (d / 20)) ** 2}[self.mode]
        return to(self.low), to(self.high)


@dataclass(frozen=True)
class Viewport:
    """What is visible: seconds and hertz."""

    start: float
    end: float
    low_hz: float = 0.0
    high_hz: float = 24_000.0

    @property
    def seconds(self) -> float:
        return self.end - self.start

    def clamped(self, low: float, high: float) -> Viewport:
        """Times moved into [low, high], with the duration kept where it fits."""
        span = min(self.seconds, high - low)
        start = min(max(self.start, low), high - span)
        return replace(self, start=start, end=start + span)

    def followed(self, now: float, total: float, mode: str = "page", anchor: float = 0.5, first: float = 0.0) -> Viewport:
        """The viewport that follows a playhead: by pages, or with the head at a fixed place."""
        if mode == "page" and self.start <= now < self.end or mode == "off":
            return self
        want = now if mode == "page" else now - self.seconds * anchor
        start = max(first, min(total - self.seconds, want))
        return replace(self, start=start, end=start + self.seconds)


@dataclass(frozen=True)
class Navigation:
    """A viewport with its bounds and spans; each move gives a new one."""

    view: Viewport
    seconds: float
    nyquist: float
    least: float = 0.05
    most: float = 40.0
    least_hz: float = 10.0

    @classmethod
    def opened(cls, seconds: float, rate: float, first: float = 10.0) -> Navigation:
        """What a recording shows at first: its beginning, up to the Nyquist frequency."""
        return cls(Viewport(0.0, min(first, seconds), 0.0, rate / 2), seconds, rate / 2)

    def pan(self, by: float) -> Navigation:
        return self.pan_to(self.view.start + by)

    def pan_to(self, start: float) -> Navigation:
        start = min(max(start, 0.0), max(0.0, self.seconds - self.view.seconds))
        return replace(self, view=replace(self.view, start=start, end=start + self.view.seconds))

    def zoom(self, factor: float, centre: float | None = None) -> Navigation:
        v = self.view
        start, end = _scaled(v.start, v.end, (0.0, self.seconds), (self.least, self.most), factor, centre)
        return replace(self, view=replace(v, start=start, end=end))

    def zoom_hz(self, factor: float, centre: float | None = None) -> Navigation:
        v = self.view
        low, high = _scaled(v.low_hz, v.high_hz, (0.0, self.nyquist), (self.least_hz, self.nyquist), factor, centre)
        return replace(self, view=replace(v, low_hz=low, high_hz=high))

    def zoom_both(self, factor: float, time: float | None = None, hz: float | None = None) -> Navigation:
        return self.zoom(factor, time).zoom_hz(factor, hz)


def rescaled(low, high, bound_low, bound_high, share, factor, shortest, longest, least: Callable = min, greatest: Callable = max):
    """Both ends of a range whose span is scaled, with the point at ``share`` of it fixed.

    The new span lies between the shortest and the longest, which the bounds limit, and a
    range that overhangs a bound is shifted by the overhang. Ends are numbers, or columns
    with ``least`` and ``greatest`` to match.
    """
    old = high - low
    span = least(greatest(old * factor, shortest), longest, bound_high - bound_low)
    start = low + share * (old - span)
    start = start - greatest(start + span - bound_high, start * 0) + greatest(bound_low - start, start * 0)
    return start, start + span


def _scaled(low: float, high: float, bounds: tuple[float, float], spans: tuple[float, float], factor: float, centre: float | None) -> tuple[float, float]:
    """``rescaled`` about a centre, by default the middle; the same range if the arguments
    make no sense or nothing would change."""
    if not 0 < factor < math.inf or bounds[0] >= bounds[1]:
        return low, high
    share = 0.5 if centre is None or high <= low else (centre - low) / (high - low)
    new = rescaled(low, high, *bounds, share, factor, *spans)
    return (low, high) if abs(new[1] - new[0] - (high - low)) < 1e-9 else new
