"""Axis ticks and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chirpline.functions.scales import js_round

#: Time steps between major ticks in seconds (fixed values).
TIME_STEPS = [
    0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5,
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 28800, 86400,
]
#: Candidates of the mel axis in hertz (fixed values).
MEL_TICKS = [
    0, 50, 100, 200, 300, 400, 500, 700, 1000, 1500, 2000, 3000, 4000, 5000, 6000,
    7000, 8000, 10000, 12000, 14000, 16000, 18000, 20000, 22050, 24000,
]


def time_step(start: Column, end: Column, width: Column, spacing: float = 75) -> Column:
    """The smallest standard step that keeps major ticks ``spacing`` pixels apart."""
    raw = F.greatest(F.lit(1e-6), end - start) / F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), width) / spacing))
    steps = F.array(*[F.lit(float(s)) for s in TIME_STEPS])
    return F.coalesce(F.get(F.filter(steps, lambda s: s >= raw), 0), F.lit(float(TIME_STEPS[-1])))


def minor_parts(step: Column) -> Column:
    """Minor steps in a major one: 6 in half and whole hours, 4 where the step is a 2 of the
    decimal ladder but no minutes, else 5."""
    lead = step / F.pow(F.lit(10.0), F.floor(F.log10(step)))
    return F.when(step.isin(1800.0, 3600.0), 6).when((F.abs(lead - 2) < 0.1) & (step > 0.0005) & (step != 120.0), 4).otherwise(5)


def ticks_between(start: Column, end: Column, step: Column) -> Column:
    """Multiples of the step in the range, to ten decimals."""
    first, last = F.floor((start - 1e-9) / step), F.ceil((end + 1e-9) / step)
    all_ticks = F.transform(F.sequence(first, last), lambda k: F.round(k * step, 10))
    return F.filter(all_ticks, lambda t: (t >= start - 1e-9) & (t <= end + 1e-9))


def fixed(x: Column, decimals: Column) -> Column:
    """Fixed-point text of non-negative values with a number of decimals that varies by row, at
    most four: the nearest to the double itself, ties to even, as C's printf gives it. Spark's
    ``format_string`` rounds the shortest decimal text of a double half up instead."""
    whole = F.floor(x)
    part = x - whole
    by = F.element_at(F.array(*[F.lit(10.0**d) for d in range(5)]), F.greatest(F.lit(1), F.least(F.lit(5), decimals.cast("int") + 1)))
    # the product as two exact doubles: 26 bits of the part, and what is left of it
    high = F.floor(part * 2.0**26) / 2.0**26
    units = F.floor(high * by)
    over = (high * by - units - 0.5) + (part - high) * by
    odd = F.when(by == 1, whole % 2).otherwise(units % 2) == 1
    units = units + F.when((over > 0) | (over == 0) & odd, 1).otherwise(0)
    carried = (whole + F.when(units >= by, 1).otherwise(0)).cast("string")
    digits = F.substring((units % by + by).cast("long").cast("string"), 2, 4)
    exact = F.when(by == 1, carried).otherwise(F.concat(carried, F.lit("."), digits))
    # beyond, doubles are whole numbers, or none
    return F.when(x < 2.0**53, exact).otherwise(F.concat(F.format_string("%.0f", x), F.when(by == 1, "").otherwise(F.concat(F.lit("."), F.substring(by.cast("long").cast("string"), 2, 4)))))


def time_label(seconds: Column, step: Column, style: str | Callable[[Column], Column] = "auto") -> Column:
    """Label of a time: 'auto', 'seconds', 'timecode', 'hhmmss' or a column function."""
    if callable(style):
        return style(seconds)
    # format_string would write nulls out
    return F.when(seconds.isNotNull(), _time_label(seconds, step, style))


def _time_label(seconds: Column, step: Column, style: str) -> Column:
    a = F.abs(seconds)
    sign = F.when(seconds < 0, "-").otherwise("")
    places = F.ceil(-F.log10(step))
    fine = step < 1

    def decimals(low, high, otherwise):
        return F.when(fine, F.least(F.lit(high), F.greatest(F.lit(low), places))).otherwise(F.lit(otherwise))

    h, m, s = F.floor(a / 3600), F.floor((a % 3600) / 60), F.floor(a % 60)
    if style == "seconds":
        return F.concat(sign, fixed(a, decimals(0, 4, 0)), F.lit("s"))
    if style in ("timecode", "hhmmss"):
        whole = F.format_string("%02d:%02d:%02d", h, m, s)
        return F.concat(sign, F.when(fine, F.concat(whole, F.format_string(".%03d", F.floor((a % 1) * 1000)))).otherwise(whole))
    part = F.when(fine, F.substring(fixed(a % 1, F.least(F.lit(3), places)), 2, 9)).otherwise("")
    return F.concat(
        sign,
        F.when(a < 1, F.concat(fixed(a, decimals(1, 4, 2)), F.lit("s")))
        .when(a < 60, F.concat(fixed(a, decimals(0, 3, 0)), F.lit("s")))
        .when(a < 3600, F.concat(F.format_string("%d:%02d", F.floor(a / 60), s), part))
        .otherwise(F.format_string("%d:%02d:%02d", h, m, s)),
    )


def frequency_label(hz: Column, style: str | Callable[[Column], Column] = "auto") -> Column:
    """Label of a frequency: 'auto', 'hz', 'khz' or a column function."""
    if callable(style):
        return style(hz)
    a = F.abs(hz)
    plain = F.concat(js_round(a).cast("string"), F.lit(" Hz"))
    if style == "hz":
        return plain
    if style == "khz":
        return F.concat(fixed(a / 1000, F.lit(2)), F.lit(" kHz"))
    k = a / 1000
    return F.when(a < 1000, plain).when(k % 1 == 0, F.concat(k.cast("long").cast("string"), F.lit(" kHz"))).otherwise(F.concat(fixed(k, F.lit(1)), F.lit(" kHz")))


def multiples(low: Column, high: Column, of: Column) -> Column:
    """Multiples of a step in a range, each rounded to whole hertz (so that small steps repeat)."""
    every = F.transform(F.sequence(F.floor(low / of), F.floor((high + 1e-6) / of)), lambda k: js_round(k * of).cast("double"))
    return F.filter(every, lambda f: (f >= low) & (f <= high))


def spaced(candidates: Column, least: Column | float, place: Callable[[Column], Column]) -> Column:
    """Of ascending candidates those that are ``least`` pixels from the last that was taken."""
    nothing = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(None).cast("double").alias("at"))
    fits = lambda taken, f: taken["at"].isNull() | (F.abs(place(f) - taken["at"]) >= least)
    step = lambda taken, f: F.when(fits(taken, f), F.struct(F.array_append(taken["kept"], f).alias("kept"), place(f).alias("at"))).otherwise(taken)
    return F.aggregate(candidates, nothing, step)["kept"]


def frequency_ticks(low: Column, high: Column, height: Column, scale: str = "linear", spacing: float = 45) -> tuple[Column, Column]:
    """(major, minor): ticks in hertz of an axis for each row, as arrays.

    Linear axes take the smallest step of the 1-2-5 ladder up to 50 kHz that keeps ticks
    ``spacing`` pixels apart, and fifths of it. On the others candidates are taken one after
    another if they are far enough from the last.
    """
    numbers = lambda ns: F.array(*[F.lit(float(n)) for n in ns])
    low = F.greatest(F.lit(0.0), low.cast("double"))
    high, height = F.greatest(low + 1, high.cast("double")), F.greatest(F.lit(1.0), height.cast("double"))
    inside = lambda ns: F.filter(numbers(ns), lambda f: (f >= low) & (f <= high))
    if scale == "linear":
        ladder = [m * 10**e for e in range(5) for m in (1, 2, 5)]
        raw = (high - low) / F.greatest(F.lit(1), F.floor(height / spacing))
        step = F.coalesce(F.get(F.filter(numbers(ladder), lambda s: s >= raw), 0), F.lit(float(ladder[-1])))
        return multiples(low, high, step), multiples(low, high, step / 5)
    if scale == "log":
        on_axis = lambda f: F.log10(F.greatest(F.lit(1.0), f))
        decades = lambda mantissas, top: [m * 10**e for e in range(1, 5) for m in mantissas if m * 10**e <= top]
        candidates, fine, least = inside(decades((1, 2, 5), 20_000)), inside(decades(range(1, 10), 50_000)), spacing * 0.75
    else:
        on_axis = lambda f: 2595 * F.log10(1 + f / 700)
        candidates, fine, least = inside(MEL_TICKS), None, spacing
    major = spaced(candidates, least, lambda f: (1 - (on_axis(f) - on_axis(low)) / (on_axis(high) - on_axis(low))) * height)
    return major, F.array().cast("array<double>") if fine is None else F.array_except(fine, major)
