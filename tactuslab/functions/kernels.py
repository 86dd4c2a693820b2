"""Numerical kernels as column expressions: closed forms and iterations of a fixed number of steps.

Bisection and golden section keep their bracket in a struct that aggregate() carries over a sequence of
steps. Sums of many powers (optimized_elapsed, with_dates, elapsed_at, elapsed_table and date_at with a table) are numpy over batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

GOLDEN = (sqrt(5) + 1) / 2
#: Steps after which golden section on [0.1, 5] is narrower than a millionth.
GOLDEN_STEPS = 33


def fixed(x: Column, digits: int = 6) -> Column:
    """x in whole units of ten to the -digits: how results are compared between engines."""
    return F.floor(x * float(10**digits) + 0.5).cast("long")


def clamp(low: float, x: Column, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def spread_intensity(onsets: Column) -> Column:
    """The exponent that best maps the even ranks of onsets, sorted and scaled to 0..1, onto them.

    Golden section on [0.1, 5] for the least sum of squares; 1 for two onsets or fewer.
    """
    n = F.size(onsets)

    def error(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.pow(F.get(onsets, i) - F.pow(i / (n - 1), p), F.lit(2.0)))

    def step(b: Column, _: Column) -> Column:
        c, d = b.hi - (b.hi - b.lo) / GOLDEN, b.lo + (b.hi - b.lo) / GOLDEN
        low = error(c) < error(d)
        return F.struct(F.when(low, b.lo).otherwise(c).alias("lo"), F.when(low, d).otherwise(b.hi).alias("hi"))

    start = F.struct(F.lit(0.1).alias("lo"), F.lit(5.0).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(GOLDEN_STEPS)), start, step, lambda b: (b.lo + b.hi) / 2)
    return F.when(n <= 2, 1.0).otherwise(end)


def rubato_on_date(date: Column, start: Column, length: Column, intensity: Column, late: Column, early: Column) -> Column:
    """Where a rubato of repeating frames puts a score date."""
    late, early = clamp(0.0, F.coalesce(late, F.lit(0.0)), 0.9), clamp(0.1, F.coalesce(early, F.lit(1.0)), 1.0)
    at = (date - start) % length
    return date + (F.pow(at / length, F.coalesce(intensity, F.lit(1.0))) * (early - late) + late) * length - at


def rubato_removed(date: Column, start: Column, length: Column, intensity: Column, late: Column, early: Column, steps: int = 40) -> Column:
    """The score date in the first frame that a rubato puts at date, by bisection to below a tick's fraction."""

    def step(b: Column, _: Column) -> Column:
        mid = (b.lo + b.hi) / 2
        below = rubato_on_date(mid, start, length, intensity, late, early) < date
        return F.struct(F.when(below, mid).otherwise(b.lo).alias("lo"), F.when(below, b.hi).otherwise(mid).alias("hi"))

    begin = F.struct(start.cast("double").alias("lo"), (start + length).cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step, lambda b: (b.lo + b.hi) / 2)


def tempo_at(date: Column, start: Column, end: Column, bpm: Column, to: Column, mean_at: Column) -> Column:
    """Beats a minute at a date of a power-curve transition; 100 without a tempo."""
    x = (date - start) / F.nullif(end - start, F.lit(0.0))
    p = F.lit(log(0.5)) / F.log(F.coalesce(mean_at, F.lit(0.5)))
    moving = F.pow(x, p) * (to - bpm) + bpm
    constant = to.isNull() | (to == 0)
    return F.when(bpm.isNull() | (bpm == 0), 100.0).when(constant, bpm).when(date >= end, to).otherwise(moving)


def constant_ms(ticks: Column, bpm: Column, beat_length: Column) -> Column:
    return 15000.0 * ticks / (bpm * beat_length * 720)


def ms_at(date: Column, start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column) -> Column:
    """Milliseconds from a tempo's start to a date: closed for a constant one, else Simpson's rule with two steps a quarter of a quarter note."""
    p = F.lit(log(0.5)) / F.log(F.coalesce(mean_at, F.lit(0.5)))
    set_up = F.struct((date - start).cast("double").alias("d"), F.greatest(F.floor((date - start) / 180), F.lit(1)).cast("int").alias("half"), p.alias("p"), (end - start).cast("double").alias("span"))

    def simpson(s: Column) -> Column:
        # Inverse tempo at k of the 2 * half steps; past the end it stays what the end has.
        inverse = lambda k: 1 / (bpm + (to - bpm) * F.pow(F.least(F.lit(1.0), k * s.d / (2 * s.half * s.span)), s.p))
        inner = F.aggregate(F.sequence(F.lit(1), 2 * s.half - 1), F.lit(0.0), lambda t, k: t + (2 + 2 * (k % 2)) * inverse(k))
        return s.d * 2500 / (s.half * beat_length * 720) * (1 / bpm + inverse(2 * s.half) + inner)

    moving = F.when(date == start, 0.0).otherwise(let(set_up, simpson))
    return F.when(to.isNull() | (to == 0), constant_ms(date - start, bpm, beat_length)).otherwise(moving)


#: Parts of a transition in a table of elapsed time, and steps on from what it says.
MARKS = 16
TABLE_STEPS = 2


def _moving(to: Column) -> Column:
    return to.isNotNull() & (to != 0)


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype("float64") for c in columns]


def _simpson(d: np.ndarray, span: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, beat: np.ndarray) -> np.ndarray:
    """ms_at of transitions at d ticks from their start, blocks of rows of about as many steps at a time."""
    half, out, k = _halves(np.where(np.isnan(d), 0.0, d)), np.empty(len(d)), 0
    order = np.argsort(half, kind="stable")
    while k < len(order):
        rows = order[k : k + max(1, 131072 // int(half[order[min(k + 255, len(order) - 1)]]) // 2)][:256]
        k += len(rows)
        h, u, v, w, q = half[rows], d[rows], a[rows], (b - a)[rows], p[rows]
        each = np.arange(1, 2 * int(h[-1]))[:, None]
        place = np.log(u / (2 * h * span[rows]))
        share = np.exp(q * np.minimum(0.0, place + np.log(each)))
        inner = np.where(each < 2 * h, (2 + 2 * (each % 2)) / (v + w * share), 0.0).sum(0)
        last = 1 / (v + w * np.exp(q * np.minimum(0.0, place + np.log(2.0 * h))))
        out[rows] = np.where(u == 0, 0.0, u * 2500 / (h * beat[rows] * 720) * (1 / v + last + inner))
    return out


def _power(mean_at: np.ndarray) -> np.ndarray:
    return log(0.5) / np.log(mean_at)


def elapsed_at(date: Column, start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column) -> Column:
    """ms_at by numpy over batches: transitions of some hundred steps are quick too."""

    @F.arrow_udf("double")
    def at(date: pa.Array, start: pa.Array, end: pa.Array, a: pa.Array, beat: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        date, start, end, a, beat, b, m = _numbers(date, start, end, a, beat, b, m)
        out = np.full(len(date), np.nan)
        rows = np.flatnonzero(~np.isnan(date + start + end + a + beat + b))
        with np.errstate(all="ignore"):
            out[rows] = _simpson((date - start)[rows], (end - start)[rows], a[rows], b[rows], _power(m[rows]), beat[rows])
        return pa.array(out, mask=np.isnan(out))

    given = [x.cast("double") for x in (F.when(_moving(to), date), start, end, bpm, beat_length, to, F.coalesce(mean_at, F.lit(0.5)))]
    return F.when(_moving(to), at(*given)).otherwise(constant_ms(date - start, bpm, beat_length))


def elapsed_table(start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column) -> Column:
    """ms_at at MARKS equal parts of a transition, its begin and its end included; null for a constant tempo."""

    @F.arrow_udf("array<double>")
    def table(start: pa.Array, end: pa.Array, a: pa.Array, beat: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        start, end, a, beat, b, m = _numbers(start, end, a, beat, b, m)
        known = ~np.isnan(start + end + a + beat + b) & (end > start)
        many = [np.repeat(x[known], MARKS + 1) for x in (end - start, a, b, _power(m), beat)]
        with np.errstate(all="ignore"):
            at = _simpson(many[0] * np.tile(np.arange(MARKS + 1), int(known.sum())) / float(MARKS), *many)
        offsets = np.concatenate([[0], np.cumsum(np.where(known, MARKS + 1, 0))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~known, False)), pa.array(at))

    return table(*[x.cast("double") for x in (start, end, bpm, beat_length, F.when(to != 0, to), F.coalesce(mean_at, F.lit(0.5)))])


def _in_table(ms: Column, table: Column, start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column) -> Column:
    """The date at ms: the table's part that holds it, a line across it, and from there a few of Newton's steps that don't leave it."""

    @F.arrow_udf("double")
    def within(ms: pa.Array, table: pa.Array, start: pa.Array, end: pa.Array, a: pa.Array, beat: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        ms, start, end, a, beat, b, m = _numbers(ms, start, end, a, beat, b, m)
        out = np.full(len(ms), np.nan)
        rows = np.flatnonzero(~np.isnan(ms + start + end + a + beat + b) & np.asarray(table.is_valid()))
        marks = _numbers(table.take(pa.array(rows)).flatten())[0].reshape(-1, MARKS + 1)
        ms, start, end, a, beat, b, p = (x[rows] for x in (ms, start, end, a, beat, b, _power(m)))
        with np.errstate(all="ignore"):
            span = end - start
            each, k = np.arange(len(rows)), np.clip((marks <= ms[:, None]).sum(1) - 1, 0, MARKS - 1)
            width, low, high = span / float(MARKS), marks[each, k], marks[each, k + 1]
            first = width * k
            d = first + width * np.where(high > low, (ms - low) / (high - low), 0.0)
            for _ in range(TABLE_STEPS):
                rate = (a + (b - a) * np.minimum(1.0, d / span) ** p) * beat * 720 / 15000.0
                d = np.clip(d + (ms - _simpson(d, span, a, b, p, beat)) * rate, first, first + width)
            out[rows] = start + d
        return pa.array(out, mask=np.isnan(out))

    return within(ms, table, *[x.cast("double") for x in (start, end, bpm, beat_length, to, F.coalesce(mean_at, F.lit(0.5)))])


def date_at(ms: Column, start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column, steps: int = 10, table: Column | None = None) -> Column:
    """The date that a tempo reaches after ms: closed for a constant one, else by Newton's steps on ms_at, to whole ticks.

    Past the end of a transition time goes on at its last tempo, before its start at its first. With a table of
    elapsed_table the steps begin where it says, and few are needed.
    """
    linear = start + ms / 1000.0 * (bpm * beat_length * 4 / 60) * 720
    rest = [start, end, bpm, beat_length, to, mean_at]
    after = lambda whole: end + (ms - whole) / 1000.0 * (to * beat_length * 4 / 60) * 720
    if table is not None:
        whole = F.get(table, F.lit(MARKS))
        moving = F.when(ms >= whole, after(whole)).otherwise(_in_table(F.when((ms > 0) & (ms < whole), ms), table, *rest))
    else:
        ticks_per_ms = lambda d: tempo_at(d, start, end, bpm, to, mean_at) * beat_length * 720 / 15000.0
        step = lambda d, _: F.greatest(start.cast("double"), F.least(end.cast("double"), d + (ms - ms_at(d, *rest)) * ticks_per_ms(d)))
        inside = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ((start + end) / 2).cast("double"), step)
        moving = let(ms_at(end, *rest), lambda whole: F.when(ms >= whole, after(whole)).otherwise(inside))
    moving = F.when(ms <= 0, linear).otherwise(js_round(moving).cast("double"))
    return F.when(to.isNull() | (to == 0), linear).otherwise(moving)


def _elapsed_to(d: np.ndarray, half: np.ndarray, span: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, beat: np.ndarray) -> np.ndarray:
    """ms_at of transitions at d ticks from their start, by Simpson's rule with 2 * half steps."""
    inner, steps = np.zeros(len(d)), 2 * half
    k = 1
    rows = np.flatnonzero(steps > 1)
    while len(rows):
        inner[rows] += (2 + 2 * (k % 2)) / (a[rows] + (b - a)[rows] * np.minimum(1.0, k * d[rows] / (steps[rows] * span[rows])) ** p[rows])
        k += 1
        rows = rows[steps[rows] > k]
    last = 1 / (a + (b - a) * np.minimum(1.0, d / span) ** p)
    return np.where(d == 0, 0.0, d * 2500 / (half * beat * 720) * (1 / a + last + inner))


def _halves(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(d / 180), 1).astype("int64")


def _date_within(ms: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, beat: np.ndarray, b: np.ndarray, mean_at: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole dates at which transitions have taken ms, that lie within them, and by how many milliseconds they miss it.

    The rule's steps grow by two every 180 ticks, where its result jumps, and a time can be met on both sides. So the
    stretches beside the one that Newton's steps end in are tried where they hold the time; the date with the nearest counts.
    """
    p, span = log(0.5) / np.log(np.where(np.isnan(mean_at), 0.5, mean_at)), end - start

    def newton(d: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, half) -> np.ndarray:
        c = [x[rows] for x in (span, a, b, p, beat)]
        for _ in range(steps):
            rate = (c[1] + (c[2] - c[1]) * np.minimum(1.0, d / c[0]) ** c[3]) * c[4] * 720 / 15000.0
            d = np.maximum(low, np.minimum(high, d + (ms[rows] - _elapsed_to(d, half(d), *c)) * rate))
        return d

    every = np.arange(len(ms))
    d = newton(span / 2, every, np.zeros(len(ms)), span, _halves)
    own = _halves(d)

    def rounded(d: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.maximum(np.floor(start[rows] + d + 0.5) - start[rows], 0.0), span[rows])
        return at, np.abs(_elapsed_to(at, _halves(at), *(x[rows] for x in (span, a, b, p, beat))) - ms[rows])

    best, off = rounded(d, every)
    for side in (-1, 1):
        half = own + side
        low, high = np.where(half == 1, 0.0, half * 180.0), np.minimum((half + 1) * 180.0, span)
        rows = np.flatnonzero((half >= 1) & (low < span))
        at = lambda x: _elapsed_to(x[rows], half[rows], *(y[rows] for y in (span, a, b, p, beat)))  # noqa: B023, E731
        rows = rows[(at(low) <= ms[rows] + 1) & (at(high) >= ms[rows] - 1)]
        if len(rows):
            found, miss = rounded(newton((low + high)[rows] / 2, rows, low[rows], high[rows], lambda _: half[rows]), rows)  # noqa: B023
            nearer = miss < off[rows]
            best[rows[nearer]], off[rows[nearer]] = found[nearer], miss[nearer]
    return np.floor(start + best + 0.5), off


def with_dates(rows: DataFrame, out: str, ms: Column, start: Column, end: Column, bpm: Column, beat_length: Column, to: Column, mean_at: Column, steps: int = 20) -> DataFrame:
    """rows with out, what date_at is for, by numpy over batches: the whole date at which a tempo has taken ms.

    Of dates that take about as long the one that comes nearest counts, so that it inverts ms_at.
    """
    names = [f"_at_{k}" for k in range(7)]
    given = rows.select("*", *[x.cast("double").alias(n) for n, x in zip(names, (ms, start, end, bpm, beat_length, to, mean_at), strict=True)])

    def dates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ms, start, end, bpm, beat, to, mean_at = [batch[n].to_numpy("float64", na_value=np.nan) for n in names]
            with np.errstate(all="ignore"):
                at = start + ms / 1000.0 * (bpm * beat * 4 / 60) * 720
                moving = np.flatnonzero((to != 0) & (ms > 0) & ~np.isnan(ms + start + end + bpm + beat + to))
                p = log(0.5) / np.log(np.where(np.isnan(mean_at), 0.5, mean_at))
                span = (end - start)[moving]
                whole = _elapsed_to(span, _halves(span), span, *(x[moving] for x in (bpm, to, p, beat)))
                inside, off = _date_within(*[x[moving] for x in (ms, start, end, bpm, beat, to, mean_at)], steps)
                rate = (to * beat * 4 / 60)[moving] * 720 / 1000.0
                after = end[moving] + (ms[moving] - whole) * rate
                past = (ms[moving] >= whole) & (np.abs(np.floor(after + 0.5) - after) / rate <= off)
                at[moving] = np.where(past, np.floor(after + 0.5), inside)
            yield batch.drop(columns=names).assign(**{out: at})

    return given.mapInPandas(dates, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def control_points(curvature: Column, protraction: Column) -> tuple[Column, Column]:
    """Where on the time axis, from 0 to 1, the inner control points of a dynamics curve lie.

    Without protraction they lie curvature inside the ends; it moves both towards the end, or below 0 towards
    the begin, by its share of what lies there.
    """
    c, p = F.coalesce(curvature, F.lit(0.5)), F.coalesce(protraction, F.lit(0.0))
    late = p > 0
    return F.when(late, c + (1 - c) * p).otherwise(c + c * p), F.when(late, 1 - c + c * p).otherwise(1 - c + (1 - c) * p)


def curve_place(date: Column, start: Column, end: Column, x1: Column, x2: Column) -> Column:
    """The curve parameter at a date: of a bracket of 0 to 1 that is halved on, the first middle that meets the date to a tick.

    The bracket is carried as its lower end, its width being that of the step; a middle that has met is carried as its negative.
    """
    powers = ((3 * x1).alias("once"), (3 * x2 - 6 * x1).alias("twice"), (3 * x1 - 3 * x2 + 1).alias("thrice"))
    set_up = F.struct((end - start).cast("double").alias("ticks"), (date - start).cast("double").alias("at"), *powers)

    def solve(c: Column) -> Column:
        def halve(low: Column, half: Column) -> Column:
            m = low + half
            ahead = c.ticks * (m * (c.once + m * (c.twice + m * c.thrice))) - c["at"]
            return F.when(low < 0, low).when(F.abs(ahead) < 1, -m).when(ahead <= 0, m).otherwise(low)

        # A curve passes no tick faster than a few in each part of its parameter.
        steps = F.greatest(F.lit(4), F.ceil(F.log2(F.greatest(c.ticks, F.lit(2.0)))).cast("int") + 4)
        halves = F.slice(F.lit([0.5**k for k in range(1, 65)]), F.lit(1), steps)
        return F.aggregate(halves, F.lit(0.0), halve, lambda low: F.when(low < 0, -low).otherwise(low + F.pow(F.lit(0.5), steps + 1)))

    return F.when(date == start, 0.0).when(date == end, 1.0).otherwise(let(set_up, solve))


def eased(date: Column, start: Column, end: Column, value: Column, to: Column, curvature: Column, protraction: Column, zero_is_unset: bool = True) -> Column:
    """Volume or position at a date of a curve from value to another; value itself without one or before the start."""
    none = to.isNull() | (value == to)
    if zero_is_unset:
        none = none | (to == 0)
    t = curve_place(date, start, end, *control_points(curvature, protraction))
    return F.when((date < start) | none, value).when(date >= end, to).otherwise(let(t, lambda t: (3.0 - 2.0 * t) * t * t * (to - value) + value))


def elapsed_ms(start_bpm: Column, end_bpm: Column, mean_at: Column, beats: Column, steps: int = 200) -> Column:
    """Milliseconds of a segment by trapezoids over a power curve; 0 for no length."""
    set_up = F.struct((F.lit(log(0.5)) / F.log(clamp(0.001, mean_at, 0.999))).alias("p"), start_bpm.alias("a"), (end_bpm - start_bpm).alias("d"))

    def total(c: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda s, i: s + 60000.0 / (c.a + c.d * F.pow(i / float(steps), c.p)))
        return (inner + 30000.0 / c.a + 30000.0 / (c.a + c.d)) * beats / float(steps)

    return F.when(beats <= 0, 0.0).when(F.abs(start_bpm - end_bpm) < 0.01, beats * 60000.0 / start_bpm).otherwise(let(set_up, total))


_LOG_STEPS = np.log(np.arange(1, 200) / 200.0)


def _elapsed(a: np.ndarray, b: np.ndarray, mean_at: np.ndarray, beats: np.ndarray) -> np.ndarray:
    """elapsed_ms of moving segments, a block at a time so that what it needs stays in the cache."""
    out = np.empty(len(a))
    p = log(0.5) / np.log(np.fmax(0.001, np.fmin(mean_at, 0.999)))
    for k in range(0, len(a), 512):
        s = slice(k, k + 512)
        inner = (60000.0 / (a[s, None] + (b - a)[s, None] * np.exp(p[s, None] * _LOG_STEPS))).sum(1)
        out[s] = (inner + 30000.0 / a[s] + 30000.0 / b[s]) * beats[s] / 200
    return out


def _bisected(a: np.ndarray, b: np.ndarray, beats: np.ndarray, target: np.ndarray, rising: np.ndarray, steps: int) -> np.ndarray:
    """The shape at which segments last target, to a tenth of a millisecond; those that have met it aren't looked at again."""
    low, high, out = np.full(len(a), 0.02), np.full(len(a), 0.98), np.full(len(a), np.nan)
    open_ = np.arange(len(a))
    for _ in range(steps):
        mid = (low[open_] + high[open_]) / 2
        ms = _elapsed(a[open_], b[open_], mid, beats[open_])
        met, below = np.abs(ms - target[open_]) < 0.1, (ms < target[open_]) == rising[open_]
        out[open_[met]] = mid[met]
        low[open_[~met & below]], high[open_[~met & ~below]] = mid[~met & below], mid[~met & ~below]
        open_ = open_[~met]
        if not len(open_):
            break
    return np.where(np.isnan(out), (low + high) / 2, out)


def optimized_elapsed(start_bpm: Column, end_bpm: Column, mean_at: Column, beats: Column, target_ms: Column, steps: int = 50) -> Column:
    """start_bpm, end_bpm, mean_tempo_at and bpm_scaled so that a segment lasts target_ms.

    The shape is bisected in [0.02, 0.98]; what no shape reaches scales the tempos; a segment of nearly
    one tempo gets the one it needs. Numpy over batches: a shape takes some three thousand powers.
    """

    @F.pandas_udf("start_bpm double, end_bpm double, mean_tempo_at double, bpm_scaled boolean")
    def fit(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series, ms: pd.Series) -> pd.DataFrame:
        a, b, m, n, ms = (x.to_numpy("float64", na_value=np.nan).copy() for x in (a, b, m, n, ms))
        with np.errstate(all="ignore"):
            scaled, flat = np.zeros(len(a), bool), (np.abs(a - b) < 0.5)
            kept = (n <= 0) | (ms <= 0)
            flat &= ~kept
            moving = np.flatnonzero(~kept & ~flat)
            x, y, k, t = a[moving], b[moving], n[moving], ms[moving]
            at02, at98 = _elapsed(x, y, np.full(len(x), 0.02), k), _elapsed(x, y, np.full(len(x), 0.98), k)
            within = (t >= np.minimum(at02, at98)) & (t <= np.maximum(at02, at98))
            hit, missed = moving[within], moving[~within]
            scale = _elapsed(a[missed], b[missed], m[missed], n[missed]) / ms[missed]
            m[hit] = _bisected(x[within], y[within], k[within], t[within], (at98 > at02)[within], steps)
            needed = (n * 60000.0 / ms)[flat]
            scaled[flat] = np.abs(needed - (a[flat] + b[flat]) / 2) > 0.5
            a[flat], b[flat], m[flat] = needed, needed, 0.5
            a[missed], b[missed], scaled[missed] = a[missed] * scale, b[missed] * scale, True
        return pd.DataFrame({"start_bpm": a, "end_bpm": b, "mean_tempo_at": m, "bpm_scaled": scaled})

    return fit(*[x.cast("double") for x in (start_bpm, end_bpm, mean_at, beats, target_ms)])


def accentuation_at(beat: Column, children: Column, length: Column) -> Column:
    """The value of a pattern of accents (beat, value, transition_from, transition_to), sorted by beat."""
    last = F.element_at(children, -1)
    exact = F.filter(children, lambda a: a.beat == beat)
    before, after = F.filter(children, lambda a: a.beat < beat), F.filter(children, lambda a: a.beat > beat)

    def between(b: Column) -> Column:
        end = F.when(F.size(after) > 0, F.get(after, F.lit(0))["beat"]).otherwise(length + 1)
        return (beat - b.beat) * (b.transition_to - b.transition_from) / (end - b.beat) + b.transition_from

    past = F.when(last.transition_to.isNull() | (last.transition_to == 0), last.value).otherwise(last.transition_to)
    return (
        F.when(F.size(children) == 0, 0.0)
        .when(beat < F.get(children, F.lit(0))["beat"], 0.0)
        .when(beat >= length + 1, past)
        .when(F.size(exact) > 0, F.get(exact, F.lit(0))["value"])
        .otherwise(let(F.try_element_at(before, F.lit(-1)), between))
    )


#: SQL functions: name, parameters and body. Those of fixed steps carry their state through aggregate().
_POWER = "power({x}, ln(0.5D) / ln(coalesce({m}, 0.5D)))"
_INVERSE = "(1 / (bpm + (`to` - bpm) * " + _POWER.format(x="least(1D, {k} * (date - start) / (2 * greatest(floor((date - start) / 180), 1) * (`end` - start)))", m="mean_at") + "))"
_HALF = "CAST(greatest(floor((date - start) / 180), 1) AS INT)"
_ERROR = "aggregate(sequence(0, size(onsets) - 1), 0D, (s, i) -> s + power(get(onsets, i) - power(CAST(i AS DOUBLE) / (size(onsets) - 1), {p}), 2D))"
_C, _D = f"(b.hi - (b.hi - b.lo) / {GOLDEN}D)", f"(b.lo + (b.hi - b.lo) / {GOLDEN}D)"
_X1 = "if(protraction > 0, curvature + (1 - curvature) * protraction, curvature + curvature * protraction)"
_X2 = "if(protraction > 0, 1 - curvature + curvature * protraction, 1 - curvature + (1 - curvature) * protraction)"
_T = "((b.low + b.high) / 2)"
_AHEAD = f"(({_T} * (3 * {_X1} + {_T} * (3 * {_X2} - 6 * {_X1} + {_T} * (3 * {_X1} - 3 * {_X2} + 1)))) * (`end` - start) - (date - start))"
_LATE, _EARLY = "greatest(0D, least(0.9D, coalesce(late, 0D)))", "greatest(0.1D, least(1D, coalesce(early, 1D)))"


def _sql_rubato(d: str) -> str:
    at = f"(({d} - start) % length)"
    return f"({d} + (power({at} / length, coalesce(intensity, 1D)) * ({_EARLY} - {_LATE}) + {_LATE}) * length - {at})"


def _sql_tempo(d: str) -> str:
    return f"CASE WHEN bpm IS NULL OR bpm = 0 THEN 100D WHEN `to` IS NULL OR `to` = 0 THEN bpm WHEN {d} >= `end` THEN `to` ELSE bpm + (`to` - bpm) * " + _POWER.format(x=f"({d} - start) / (`end` - start)", m="mean_at") + " END"


def _sql_ms(d: str) -> str:
    """Simpson's rule as in ms_at, for a transition."""
    half = f"CAST(greatest(floor(({d} - start) / 180), 1) AS INT)"
    inverse = lambda k: "(1 / (bpm + (`to` - bpm) * " + _POWER.format(x=f"least(1D, {k} * ({d} - start) / (2 * {half} * (`end` - start)))", m="mean_at") + "))"
    inner = f"aggregate(sequence(1, 2 * {half} - 1), 0D, (t, k) -> t + (2 + 2 * (k % 2)) * {inverse('k')})"
    return f"if({d} = start, 0D, ({d} - start) * 2500 / ({half} * beat_length * 720) * (1 / bpm + {inverse(f'(2 * {half})')} + {inner}))"


_STEP = f"greatest(start, least(`end`, d + (ms - {_sql_ms('d')}) * ({_sql_tempo('d')}) * beat_length * 720 / 15000D))"
_ACCENTS = "ARRAY<STRUCT<beat: DOUBLE, value: DOUBLE, transition_from: DOUBLE, transition_to: DOUBLE>>"
_BEHIND = "filter(children, a -> a.beat > beat)"
_ACCENT = (
    f"CASE WHEN size(children) = 0 OR beat < get(children, 0).beat THEN 0D WHEN beat >= length + 1 THEN coalesce(nullif(element_at(children, -1).transition_to, 0D), element_at(children, -1).value) "
    "WHEN exists(children, a -> a.beat = beat) THEN get(filter(children, a -> a.beat = beat), 0).value "
    "ELSE get(transform(array(try_element_at(filter(children, a -> a.beat < beat), -1)), p -> (beat - p.beat) * (p.transition_to - p.transition_from) / "
    f"(coalesce(get({_BEHIND}, 0).beat, length + 1) - p.beat) + p.transition_from), 0) END"
)


def _sql_elapsed(m: str) -> str:
    """elapsed_ms of a segment of start_bpm, end_bpm and beats with the shape m."""
    moving = f"start_bpm + (end_bpm - start_bpm) * power(i / 200D, ln(0.5D) / ln(greatest(0.001D, least(0.999D, {m}))))"
    total = f"(aggregate(sequence(1, 199), 0D, (s, i) -> s + 60000D / ({moving})) + 30000D / start_bpm + 30000D / end_bpm) * beats / 200D"
    return f"(CASE WHEN beats <= 0 THEN 0D WHEN abs(start_bpm - end_bpm) < 0.01 THEN beats * 60000D / start_bpm ELSE {total} END)"


_MET, _RISES = "abs(e.ms - target_ms) < 0.1", f"{_sql_elapsed('0.98D')} > {_sql_elapsed('0.02D')}"
_BELOW = f"(e.ms < target_ms) = ({_RISES})"
_HALVED = (
    "aggregate(sequence(1, 50), struct(0.02D AS lo, 0.98D AS hi, false AS met), (b, k) -> if(b.met, b, get(transform(array(struct((b.lo + b.hi) / 2 AS mid, "
    + _sql_elapsed("((b.lo + b.hi) / 2)")
    + f" AS ms)), e -> struct(if(NOT {_MET} AND {_BELOW}, e.mid, b.lo) AS lo, if({_MET} OR {_BELOW}, b.hi, e.mid) AS hi, {_MET} AS met)), 0)), b -> (b.lo + b.hi) / 2)"
)
_SCALE = f"({_sql_elapsed('mean_at')} / target_ms)"
_NEEDED = "(beats * 60000D / target_ms)"
_OPTIMIZED = (
    "CASE WHEN beats <= 0 OR target_ms <= 0 THEN struct(start_bpm AS a, end_bpm AS b, mean_at AS m, false AS s) "
    f"WHEN abs(start_bpm - end_bpm) < 0.5 THEN struct({_NEEDED} AS a, {_NEEDED} AS b, 0.5D AS m, abs({_NEEDED} - (start_bpm + end_bpm) / 2) > 0.5 AS s) "
    f"WHEN target_ms BETWEEN least({_sql_elapsed('0.02D')}, {_sql_elapsed('0.98D')}) AND greatest({_sql_elapsed('0.02D')}, {_sql_elapsed('0.98D')}) THEN struct(start_bpm AS a, end_bpm AS b, {_HALVED} AS m, false AS s) "
    f"ELSE struct(start_bpm * {_SCALE} AS a, end_bpm * {_SCALE} AS b, mean_at AS m, true AS s) END"
)
#: A frame of ticks.frames as an element of an array.
_FRAMES = "ARRAY<STRUCT<begin_ms: DOUBLE, date: DOUBLE, end_date: DOUBLE, bpm: DOUBLE, beat_length: DOUBLE, transition_to: DOUBLE, mean_tempo_at: DOUBLE>>"
#: Table functions, for lateral joins: what holds at a time or a beat, one row at most.
SQL_TABLES = (
    ("frame_at", f"ms DOUBLE, frames {_FRAMES}", "begin_ms DOUBLE, date DOUBLE, end_date DOUBLE, bpm DOUBLE, beat_length DOUBLE, transition_to DOUBLE, mean_tempo_at DOUBLE",
     "SELECT f.begin_ms, f.date, f.end_date, f.bpm, f.beat_length, f.transition_to, f.mean_tempo_at FROM (SELECT explode(filter(slice(filter(frames, x -> x.begin_ms <= ms), -1, 1), x -> true)) AS f)"),
    ("optimized_elapsed", "start_bpm DOUBLE, end_bpm DOUBLE, mean_at DOUBLE, beats DOUBLE, target_ms DOUBLE", "bpm_from DOUBLE, bpm_to DOUBLE, mean_tempo_at DOUBLE, bpm_scaled BOOLEAN",
     f"SELECT x.a, x.b, x.m, x.s FROM (SELECT {_OPTIMIZED} AS x)"),
    ("accent_at", f"beat DOUBLE, children {_ACCENTS}", "accent_beat DOUBLE, value DOUBLE, transition_from DOUBLE, transition_to DOUBLE",
     "SELECT a.beat, a.value, a.transition_from, a.transition_to FROM (SELECT explode(slice(filter(children, x -> x.beat <= accent_at.beat), -1, 1)) AS a)"),
)
SQL_FUNCTIONS = (
    ("rubato_removed", "date DOUBLE, start DOUBLE, length DOUBLE, intensity DOUBLE, late DOUBLE, early DOUBLE",
     f"aggregate(sequence(1, 40), struct(start AS lo, start + length AS hi), (b, k) -> if({_sql_rubato('((b.lo + b.hi) / 2)')} < date, struct((b.lo + b.hi) / 2 AS lo, b.hi AS hi), struct(b.lo AS lo, (b.lo + b.hi) / 2 AS hi)), b -> (b.lo + b.hi) / 2)"),
    ("tempo_date_at", "ms DOUBLE, start DOUBLE, `end` DOUBLE, bpm DOUBLE, beat_length DOUBLE, `to` DOUBLE, mean_at DOUBLE",
     f"CASE WHEN `to` IS NULL OR `to` = 0 OR ms <= 0 THEN start + ms / 1000D * (bpm * beat_length * 4 / 60) * 720 WHEN ms >= {_sql_ms('`end`')} THEN floor(`end` + (ms - {_sql_ms('`end`')}) / 1000D * (`to` * beat_length * 4 / 60) * 720 + 0.5D) "
     f"ELSE floor(aggregate(sequence(1, 10), (start + `end`) / 2, (d, i) -> {_STEP}) + 0.5D) END"),
    ("accentuation_at", f"beat DOUBLE, children {_ACCENTS}, length DOUBLE", _ACCENT),
    ("js_round", "x DOUBLE", "floor(x + 0.5D)"),
    ("clamp", "low DOUBLE, x DOUBLE, high DOUBLE", "greatest(low, least(high, x))"),
    ("rubato_on_date", "date DOUBLE, start DOUBLE, length DOUBLE, intensity DOUBLE, late DOUBLE, early DOUBLE",
     "date + (power(((date - start) % length) / length, coalesce(intensity, 1D)) * (greatest(0.1D, least(1D, coalesce(early, 1D))) - greatest(0D, least(0.9D, coalesce(late, 0D)))) + greatest(0D, least(0.9D, coalesce(late, 0D)))) * length - (date - start) % length"),
    ("tempo_at", "date DOUBLE, start DOUBLE, `end` DOUBLE, bpm DOUBLE, `to` DOUBLE, mean_at DOUBLE",
     "CASE WHEN bpm IS NULL OR bpm = 0 THEN 100D WHEN `to` IS NULL OR `to` = 0 THEN bpm WHEN date >= `end` THEN `to` ELSE bpm + (`to` - bpm) * " + _POWER.format(x="(date - start) / (`end` - start)", m="mean_at") + " END"),
    ("tempo_ms_at", "date DOUBLE, start DOUBLE, `end` DOUBLE, bpm DOUBLE, beat_length DOUBLE, `to` DOUBLE, mean_at DOUBLE",
     f"CASE WHEN `to` IS NULL OR `to` = 0 THEN 15000D * (date - start) / (bpm * beat_length * 720) WHEN date = start THEN 0D ELSE (date - start) * 2500 / ({_HALF} * beat_length * 720) * (1 / bpm + {_INVERSE.format(k=f'(2 * {_HALF})')} + aggregate(sequence(1, 2 * {_HALF} - 1), 0D, (t, k) -> t + (2 + 2 * (k % 2)) * {_INVERSE.format(k='k')})) END"),
    ("elapsed_ms", "start_bpm DOUBLE, end_bpm DOUBLE, mean_at DOUBLE, beats DOUBLE",
     "CASE WHEN beats <= 0 THEN 0D WHEN abs(start_bpm - end_bpm) < 0.01 THEN beats * 60000D / start_bpm ELSE (aggregate(sequence(1, 199), 0D, (s, i) -> s + 60000D / (start_bpm + (end_bpm - start_bpm) * power(i / 200D, ln(0.5D) / ln(greatest(0.001D, least(0.999D, mean_at)))))) + 30000D / start_bpm + 30000D / end_bpm) * beats / 200D END"),
    ("spread_intensity", "onsets ARRAY<DOUBLE>",
     f"CASE WHEN size(onsets) <= 2 THEN 1D ELSE aggregate(sequence(1, {GOLDEN_STEPS}), struct(0.1D AS lo, 5D AS hi), (b, k) -> if({_ERROR.format(p=_C)} < {_ERROR.format(p=_D)}, struct(b.lo AS lo, {_D} AS hi), struct({_C} AS lo, b.hi AS hi)), b -> (b.lo + b.hi) / 2) END"),
    ("curve_place", "date DOUBLE, start DOUBLE, `end` DOUBLE, curvature DOUBLE, protraction DOUBLE",
     f"CASE WHEN date = start THEN 0D WHEN date = `end` THEN 1D ELSE aggregate(sequence(1, greatest(4, CAST(ceil(log2(greatest(`end` - start, 2D))) AS INT) + 4)), struct(0D AS low, 1D AS high), (b, k) -> struct(if(abs({_AHEAD}) < 1 OR {_AHEAD} <= 0, {_T}, b.low) AS low, if(abs({_AHEAD}) < 1 OR {_AHEAD} > 0, {_T}, b.high) AS high), b -> {_T}) END"),
    ("volume_at", "date DOUBLE, start DOUBLE, `end` DOUBLE, value DOUBLE, `to` DOUBLE, curvature DOUBLE, protraction DOUBLE",
     "CASE WHEN `to` IS NULL OR `to` = 0 OR `to` = value OR date < start THEN value WHEN date >= `end` THEN `to` ELSE get(transform(array(curve_place(date, start, `end`, coalesce(curvature, 0.5D), coalesce(protraction, 0D))), t -> (3 - 2 * t) * t * t * (`to` - value) + value), 0) END"),
)


def register(spark) -> None:
    """The kernels as SQL functions, under their names here; tempo_ms_at is ms_at, tempo_date_at date_at, volume_at eased.

    Those of SQL_TABLES give rows, for LATERAL joins.
    """
    for name, parameters, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
    for name, parameters, columns, body in SQL_TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
