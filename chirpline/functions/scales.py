"""Scalar functions as column expressions: value scales, frequency scales, pixels, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chirpline.config import ValueScale, Viewport, rescaled

#: The least magnitude that has a level of its own: -240 dB.
LEAST = 1e-12
#: Mel scale (fixed values).
MEL_FACTOR, MEL_CORNER = 2595.0, 700.0


def js_round(x: Column) -> Column:
    """Half up, also for negative values."""
    return F.floor(x + 0.5)


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def db_of(magnitude: Column) -> Column:
    return 20 * F.log10(F.greatest(F.lit(LEAST), F.abs(magnitude)))


def magnitude_of(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def power_of(db: Column) -> Column:
    return F.pow(F.pow(F.lit(10.0), db / 20), F.lit(2.0))


def in_mode(magnitude: Column, mode: str) -> Column:
    """A magnitude as magnitude, power or dB."""
    return {"magnitude": magnitude, "power": magnitude * magnitude, "db": db_of(magnitude)}[mode]


def array_in_mode(magnitudes: Column, mode: str) -> Column:
    return magnitudes if mode == "magnitude" else F.transform(magnitudes, lambda m: in_mode(m, mode))


def normalized(value: Column, scale: ValueScale) -> Column:
    """Position between the bounds; negative positions count as 0 before the gamma."""
    low, high = scale.bounds()
    span = (high - low) or 1.0
    x = (value - F.lit(low)) / F.lit(span)
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) if scale.clamp else F.greatest(F.lit(0.0), x)
    return x if scale.gamma == 1 else F.pow(x, F.lit(float(scale.gamma)))


def as_byte(x: Column) -> Column:
    """A normalised value in 256 steps."""
    return clamp(js_round(x * 255), F.lit(0), F.lit(255)).cast("int")


def mel_of(hz: Column) -> Column:
    return F.lit(MEL_FACTOR) * F.log10(1 + hz / MEL_CORNER)


def hz_of_mel(mel: Column) -> Column:
    return F.lit(MEL_CORNER) * (F.pow(F.lit(10.0), mel / MEL_FACTOR) - 1)


def to_scale(hz: Column, scale: str) -> Column:
    if scale == "log":
        return F.log10(F.greatest(F.lit(1.0), hz))
    return mel_of(hz) if scale == "mel" else hz


def from_scale(s: Column, scale: str) -> Column:
    if scale == "log":
        return F.pow(F.lit(10.0), s)
    return hz_of_mel(s) if scale == "mel" else s


def time_at(x: Column, width: Column, start: Column, end: Column, clamped: bool = False) -> Column:
    x = clamp(x, F.lit(0.0), width) if clamped else x
    return start + x / F.greatest(F.lit(1), width) * (end - start)


def x_at(t: Column, width: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, (t - start) / (end - start) * width).otherwise(F.lit(0.0))


def hz_at(y: Column, height: Column, low: Column, high: Column, scale: str = "linear") -> Column:
    """Frequency of a row; row 0 is the highest."""
    top, bottom = to_scale(high, scale), to_scale(low, scale)
    return from_scale(top - y / F.greatest(F.lit(1), height) * (top - bottom), scale)


def y_at(hz: Column, height: Column, low: Column, high: Column, scale: str = "linear") -> Column:
    top, bottom = to_scale(high, scale), to_scale(low, scale)
    return F.when(top > bottom, (1 - (to_scale(hz, scale) - bottom) / (top - bottom)) * height).otherwise(F.lit(0.0))


def time_and_hz(x: Column, y: Column, width: int, height: int, view: Viewport, scale: str = "linear") -> tuple[Column, Column]:
    return (
        time_at(x, F.lit(width), F.lit(view.start), F.lit(view.end)),
        hz_at(y, F.lit(height), F.lit(view.low_hz), F.lit(view.high_hz), scale),
    )


def overlaps(start: Column, end: Column, view_start, view_end) -> Column:
    """Half-open ranges that share a point."""
    return (start < view_end) & (end > view_start)


def panned(low: Column, high: Column, bound_low: Column, bound_high: Column, delta: Column) -> tuple[Column, Column]:
    """A range moved by ``delta`` inside its bounds with its span kept; unchanged if the
    bounds are empty."""
    span = high - low
    to = F.least(F.greatest(low + delta, bound_low), F.greatest(bound_low, bound_high - span))
    moved = F.when(bound_high > bound_low, to).otherwise(low)
    return moved, moved + span


def zoomed(low: Column, high: Column, bound_low: Column, bound_high: Column, centre: Column, factor: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """A range scaled about ``centre`` within spans and bounds; unchanged if nothing would
    change or an argument is out of order."""
    share = F.when(high > low, (centre - low) / (high - low)).otherwise(0.5)
    start, end = rescaled(low, high, bound_low, bound_high, share, factor, least, most, F.least, F.greatest)
    changes = (factor > 0) & (bound_high > bound_low) & (F.abs((end - start) - (high - low)) >= 1e-9)
    return F.when(changes, start).otherwise(low), F.when(changes, end).otherwise(high)


def moved_inside(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Viewport times inside [low, high], with the duration kept where it fits."""
    span = F.least(end - start, high - low)
    to = F.least(F.greatest(start, low), high - span)
    return to, to + span


def playhead_x(t: Column, width: Column, start: Column, end: Column, snap: bool = False) -> Column:
    """Pixel of the playhead, null outside the viewport."""
    x = x_at(t, width, start, end)
    return F.when((t >= start) & (t <= end), js_round(x).cast("double") if snap else x)


def sought(t: Column, seconds: Column, clip_start: Column, clip_end: Column) -> Column:
    """A time to seek to, inside the clip or, where a bound is null, the recording."""
    return F.greatest(F.coalesce(clip_start, F.lit(0.0)), F.least(F.coalesce(clip_end, seconds), t))


def filled(mag: Column, power: Column, db: Column) -> tuple[Column, Column]:
    """Arrays of powers and levels, made from magnitudes where they are null."""
    return F.coalesce(power, array_in_mode(mag, "power")), F.coalesce(db, array_in_mode(mag, "db"))
