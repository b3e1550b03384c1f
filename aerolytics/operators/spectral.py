"""Spectra, step responses and delays over overlapping segments of long signals.

A signal is (log_id, axis, i, x ...): ``i`` is the row's place in its log and axis, from 0 and without
gaps.  Rows are shuffled once, to blocks of many consecutive segments; only rows near a block's edge go
to two of them.  A long log spreads over many tasks, and a kernel cuts a block's array into its
overlapping segments by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolytics.operators import kernels
from aerolytics.operators.attach import attach
from aerolytics.operators.delays import correlation_delay, filter_delays, phase_delay  # noqa: F401
from aerolytics.operators.ordered import with_guests
from aerolytics.scratch import stored
from aerolytics.ship import ship

KEYS = ["log_id", "axis"]
#: Rows of a block, give or take a segment.
BLOCK_ROWS = 16_384


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def layout(signal: DataFrame, *scalars: str, least: int = 1) -> DataFrame:
    """(keys, n, scalars): the length of each signal and what is the same for all of its rows; signals of ``least`` rows or more."""
    return signal.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in scalars]).where(F.col("n") >= least)


def blocks(signal: DataFrame, values: list[str], layouts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, layout columns, k0, m, i, values): arrays with the rows of the segments k0 .. k0+m-1, in any order.

    ``layouts`` has one row per signal with ``size``, ``hop``, ``last`` (its segments are 0..last; none below 0) and
    ``shift``: segment k holds the rows k*hop-shift .. k*hop-shift+size-1, as far as they exist.
    """
    per = F.greatest(_div(F.lit(block_rows).cast("bigint"), F.col("hop")), F.lit(1))
    sized = layouts.where("last >= 0").withColumn("_per", per)
    held = attach(signal.select(*KEYS, "i", *values), sized, KEYS, order="i")
    at = F.col("i") + F.col("shift")
    first, until = F.greatest(_div(at - F.col("size") + F.col("hop"), F.col("hop")), F.lit(0)), F.least(_div(at, F.col("hop")), F.col("last"))
    dealt = held.where(first <= until).withColumn("_block", F.explode(F.sequence(_div(first, F.col("_per")), _div(until, F.col("_per")))))
    rows = F.collect_list(F.struct("i", *[F.col(v).cast("double").alias(v) for v in values]))
    names = [c for c in sized.columns if c not in KEYS]
    grouped = dealt.groupBy(*KEYS, *names, "_block").agg(rows.alias("rows"))
    k0 = F.col("_block") * F.col("_per")
    return grouped.select(*KEYS, *[c for c in names if c != "_per"], k0.alias("k0"), F.least(F.col("_per"), F.col("last") + 1 - k0).alias("m"), F.col("rows.i").alias("i"), *[F.col(f"rows.{v}").alias(v) for v in values])


def segments(signal: DataFrame, values: list[str], layouts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, layout columns, k, and each value as an array in order): one row per segment."""
    cut = blocks(signal, values, layouts, block_rows).withColumn("_rows", F.array_sort(F.arrays_zip("i", *values)))
    each = cut.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    start = ((F.col("k0") + F.col("_j")) * F.col("hop") - F.col("shift")).cast("bigint")
    own = F.filter("_rows", lambda r: (r["i"] >= start) & (r["i"] < start + F.col("size")))
    names = [c for c in layouts.columns if c not in KEYS]
    return each.select(*KEYS, *names, (F.col("k0") + F.col("_j")).alias("k"), own.alias("_own")).select(*KEYS, *names, "k", *[F.col(f"_own.{v}").alias(v) for v in values])


def _cut(values: np.ndarray, i: np.ndarray, k0: int, m: int, size: int, hop: int, shift: int) -> np.ndarray:
    """The segments of a block, a row each; where a row is absent stands a zero."""
    held = np.zeros((m - 1) * hop + size)
    at = i + shift - k0 * hop
    fits = (at >= 0) & (at < len(held))
    held[at[fits]] = values[fits]
    return np.lib.stride_tricks.sliding_window_view(held, size)[::hop]


def _together(kernel: Callable[..., np.ndarray], *parts: list[np.ndarray]) -> list[np.ndarray]:
    """Apply a kernel once to all rows of equal width of many matrices (or row vectors), and deal its rows back."""
    out: list = [None] * len(parts[0])
    widths = np.array([x.shape[1] for x in parts[0]])
    for width in np.unique(widths):
        of = np.flatnonzero(widths == width)
        made = kernel(*[np.concatenate([p[j] for j in of]) for p in parts])
        ends = np.cumsum([len(parts[0][j]) for j in of])
        for j, rows in zip(of, np.split(made, ends[:-1]), strict=True):
            out[j] = rows
    return out


def _block_rows(i, k0, m, size, hop, shift, *values) -> list[list[np.ndarray]]:
    """For each value, the segment matrices of the rows of a batch."""
    shape = list(zip(i, k0, m, size, hop, shift, strict=True))
    return [[_cut(x, *s) for x, s in zip(v, shape, strict=True)] for v in values]


_SHAPE = ("i", "k0", "m", "size", "hop", "shift")


def _auto(n: Column, nperseg: int, least: int, part: int) -> Column:
    return F.least(F.lit(nperseg).cast("bigint") if nperseg > 0 else F.least(n, F.greatest(F.lit(least), _div(n, F.lit(part)))).cast("bigint"), n)


def _level(power: Column, use_psd: bool) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-20))) if use_psd else F.sqrt(power)


def welch(signal: DataFrame, use_psd: bool = False, nperseg: int = 0, name: str = "hann") -> DataFrame:
    """(keys, bin, freq, amplitude) of ``x`` at ``rate``: segments overlap by half, their power is averaged; amplitude, or dB by Hz."""
    ship(signal.sparkSession)

    @F.pandas_udf("array<double>")
    def total(x: pd.Series, rate: pd.Series, *shape: pd.Series) -> pd.Series:
        (cut,) = _block_rows(*shape, x)
        rates = [np.full((len(c), 1), r) for c, r in zip(cut, rate, strict=True)]
        power = _together(lambda a, r: kernels.periodogram(a, r[:, 0], name, "density" if use_psd else "spectrum"), cut, rates)
        return pd.Series([p.sum(axis=0) for p in power])

    sized = layout(signal, "rate", least=4).withColumn("size", _auto(F.col("n"), nperseg, 256, 4))
    sized = sized.withColumn("hop", F.col("size") - _div(F.col("size"), F.lit(2))).withColumns({"last": _div(F.col("n") - F.col("size"), F.col("hop")), "shift": F.lit(0).cast("bigint")})
    power = blocks(signal, ["x"], sized).select(*KEYS, "size", "rate", "m", total("x", "rate", *_SHAPE).alias("p"))
    mean = power.select(*KEYS, "size", "rate", "m", F.posexplode("p").alias("bin", "p")).groupBy(*KEYS, "size", "rate", "bin").agg((F.sum("p") / F.sum("m")).alias("p"))
    return mean.select(*KEYS, "bin", (F.col("bin") * F.col("rate") / F.col("size")).alias("freq"), _level(F.col("p"), use_psd).alias("amplitude"))


def spectrogram(signal: DataFrame, use_psd: bool = False, nperseg: int = 0, name: str = "hann") -> DataFrame:
    """(keys, k, time_s, bin, freq, level): power by Hz of segments that overlap by three quarters, as its root or in dB."""
    ship(signal.sparkSession)

    @F.pandas_udf("array<array<double>>")
    def each(x: pd.Series, rate: pd.Series, *shape: pd.Series) -> pd.Series:
        (cut,) = _block_rows(*shape, x)
        rates = [np.full((len(c), 1), r) for c, r in zip(cut, rate, strict=True)]
        return pd.Series([list(p) for p in _together(lambda a, r: kernels.periodogram(a, r[:, 0], name, "density"), cut, rates)])

    sized = layout(signal, "rate", least=4).withColumn("size", _auto(F.col("n"), nperseg, 256, 8))
    sized = sized.withColumn("hop", F.col("size") - _div(F.col("size") * 3, F.lit(4))).withColumns({"last": _div(F.col("n") - F.col("size"), F.col("hop")), "shift": F.lit(0).cast("bigint")})
    power = blocks(signal, ["x"], sized).select(*KEYS, "size", "hop", "rate", "k0", F.posexplode(each("x", "rate", *_SHAPE)).alias("j", "p")).withColumn("k", F.col("k0") + F.col("j"))
    rows = power.select(*KEYS, "k", "size", "rate", ((F.col("size") / 2.0 + F.col("k") * F.col("hop")) / F.col("rate")).alias("time_s"), F.posexplode("p").alias("bin", "p"))
    return rows.select(*KEYS, "k", "time_s", "bin", (F.col("bin") * F.col("rate") / F.col("size")).alias("freq"), _level(F.col("p"), use_psd).alias("level"))


def slice_throttle(slices: DataFrame, throttle: DataFrame) -> DataFrame:
    """Adds ``throttle`` to slices (log_id, time_s, n, rate): linear between samples that spread evenly over the log's duration.

    Only the samples beside a slice are shuffled with the slices.
    """
    pos = F.least(F.greatest(F.col("time_s") * F.col("rate") * (F.col("n") - 1) / F.col("n"), F.lit(0.0)), (F.col("n") - 1).cast("double"))
    placed = slices.withColumn("_pos", pos).withColumns({"_lo": F.floor("_pos"), "_hi": F.least(F.floor("_pos") + 1, F.col("n") - 1)})
    wanted = placed.select("log_id", F.explode(F.array("_lo", "_hi")).alias("i")).distinct()
    near = throttle.join(wanted, ["log_id", "i"], "left_semi")
    at = lambda name, column: near.select(F.col("log_id"), F.col("i").alias(column), F.col("pct").alias(name))
    both = placed.join(at("_a", "_lo"), ["log_id", "_lo"]).join(at("_b", "_hi"), ["log_id", "_hi"])
    return both.withColumn("throttle", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo"))).drop("_pos", "_lo", "_hi", "_a", "_b")


def throttle_spectrogram(signal: DataFrame, use_psd: bool = False, bins: int = 100, nperseg: int = 0, name: str = "hann", freq_limit: float = 0.0) -> DataFrame:
    """(keys, throttle_bin, center, bin, freq, level): mean power of the time slices of each throttle bin; bins without a slice are 0.

    ``signal`` is (keys, i, x, rate, throttle) with the throttle in percent.  Half a segment of zeros stands at
    both ends.  A slice takes the throttle at its time, linear between samples that spread evenly over the
    log's duration; those lie inside the slice's own rows, so that nothing is joined.  A bin holds its lower
    end only, so 100 % is in none.
    """
    ship(signal.sparkSession)

    @F.pandas_udf("array<struct<throttle_bin:int,m:bigint,p:array<double>>>")
    def binned(x: pd.Series, throttle: pd.Series, rate: pd.Series, n: pd.Series, *shape: pd.Series) -> pd.Series:
        (cut,) = _block_rows(*shape, x)
        power = _together(lambda a: kernels.stft_power(a, name), cut)
        out = []
        for p, t, f, total, i, k0, m, size, hop, _ in zip(power, throttle, rate, n, *shape, strict=True):
            if freq_limit > 0:
                p = p[:, np.arange(p.shape[1]) * f / size <= freq_limit]
            pos = np.clip((k0 + np.arange(m)) * hop * (total - 1) / total, 0, total - 1)
            low = np.floor(pos).astype(np.int64)
            own = np.full(int(i.max()) + 2 - int(i.min()), np.nan)
            own[i - i.min()] = t
            a, b = own[low - i.min()], own[np.minimum(low + 1, total - 1) - i.min()]
            place = (a + (b - a) * (pos - low)) / (100.0 / bins)
            fits = (place >= 0) & (place < bins)
            number, where = np.unique(np.floor(place[fits]).astype(np.int64), return_inverse=True)
            sums = np.zeros((len(number), p.shape[1]))
            np.add.at(sums, where, p[fits])
            out.append([{"throttle_bin": int(b), "m": int(c), "p": s} for b, c, s in zip(number, np.bincount(where, minlength=len(number)), sums, strict=True)])
        return pd.Series(out)

    half, hop = _div(F.col("size"), F.lit(2)), F.col("size") - _div(F.col("size") * 3, F.lit(4))
    sized = layout(signal, "rate", least=4).withColumn("size", _auto(F.col("n"), nperseg, 128, 8)).withColumns({"hop": hop, "shift": half})
    plain = F.col("n") + 2 * F.col("shift")
    padded = plain + F.pmod(-(plain - F.col("size")), F.col("hop"))  # to a whole number of hops
    sized = sized.withColumn("last", _div(padded - F.col("size"), F.col("hop")))
    rows = blocks(signal, ["x", "throttle"], sized).select(*KEYS, F.explode(binned("x", "throttle", "rate", "n", *_SHAPE)).alias("b"))
    sums = rows.select(*KEYS, "b.throttle_bin", "b.m", F.posexplode("b.p").alias("bin", "p")).groupBy(*KEYS, "throttle_bin", "bin").agg((F.sum("p") / F.sum("m")).alias("p"))
    # A bin with a slice has all its frequencies, so that dense rows need a join by throttle bin only.
    levels = sums.groupBy(*KEYS, "throttle_bin").agg(F.array_sort(F.collect_list(F.struct("bin", "p")))["p"].alias("p"))
    freqs = F.transform(F.sequence(F.lit(0).cast("bigint"), _div(F.col("size"), F.lit(2))), lambda b: b * F.col("rate") / F.col("size"))
    shape = sized.select(*KEYS, (F.filter(freqs, lambda f: f <= freq_limit) if freq_limit > 0 else freqs).alias("freq"))
    full = shape.withColumn("throttle_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(levels, [*KEYS, "throttle_bin"], "left")
    dense = F.arrays_zip("freq", F.coalesce("p", F.array_repeat(F.lit(0.0), F.size("freq"))).alias("p"))
    rows = full.select(*KEYS, "throttle_bin", F.posexplode(dense).alias("bin", "at"))
    return rows.select(*KEYS, "throttle_bin", ((F.col("throttle_bin") + 0.5) * (100.0 / bins)).alias("center"), "bin", F.col("at.freq").alias("freq"), _level(F.col("at.p"), use_psd).alias("level"))


def spectral_peak(spectrum: DataFrame) -> DataFrame:
    """(keys, freq, amplitude) of the strongest frequency, the lowest among equals."""
    top = spectrum.groupBy(*KEYS).agg(F.max_by(F.struct("freq", "amplitude"), F.struct("amplitude", -F.col("freq"))).alias("t"))
    return top.select(*KEYS, "t.freq", "t.amplitude")


def box_smooth(signal: DataFrame, column: str, size: int) -> DataFrame:
    """Adds ``<column>_smooth``: centred mean of ``size`` rows, zeros beyond the ends; size 1 leaves the signal."""
    value = F.col(column).cast("double")
    if size <= 1:
        return signal.withColumn(f"{column}_smooth", value)
    own = Window.partitionBy(*KEYS, "_chunk").orderBy("i").rowsBetween(-(size // 2), (size - 1) // 2)
    spread = with_guests(signal, "i", size // 2, (size - 1) // 2)
    return spread.withColumn(f"{column}_smooth", F.sum(value).over(own) / size).where("not _guest").drop("_chunk", "_guest")


def step_segments(signal: DataFrame, min_input: float = 20.0, duration_ms: float = 500.0, segment_ms: float = 2000.0, smooth: int = 1) -> DataFrame:
    """(keys, k, response): the step response of every segment with enough input, of (setpoint, gyro, rate_khz)."""
    ship(signal.sparkSession)
    smoothed = box_smooth(signal, "gyro", smooth).drop("gyro").withColumnRenamed("gyro_smooth", "gyro")
    resp, seg = F.floor(F.lit(duration_ms) * F.col("rate_khz")).cast("bigint"), F.floor(F.lit(segment_ms) * F.col("rate_khz")).cast("bigint")
    sized = layout(signal, "rate_khz").withColumns({"resp": resp, "size": seg}).where("resp >= 2 and size >= 2 * resp").withColumn("hop", F.greatest(_div(F.col("size"), F.lit(2)), F.lit(1)))
    last = F.when(F.col("n") > F.col("size"), _div(F.col("n") - F.col("size") + F.col("hop") - 1, F.col("hop")) - 1).otherwise(-1)
    sized = sized.withColumns({"last": last.cast("bigint"), "shift": F.lit(0).cast("bigint")})

    @F.pandas_udf("array<array<double>>")
    def solve(setpoint: pd.Series, gyro: pd.Series, resp: pd.Series, *shape: pd.Series) -> pd.Series:
        x, y = _block_rows(*shape, setpoint, gyro)
        lively = [np.abs(a).max(axis=1) >= min_input for a in x]
        sizes = [np.full((int(f.sum()), 1), r) for f, r in zip(lively, resp, strict=True)]
        made = _together(kernels.wiener_steps, [a[f] for a, f in zip(x, lively, strict=True)], [b[f] for b, f in zip(y, lively, strict=True)], sizes)
        out = []
        for f, rows, r in zip(lively, made, resp, strict=True):
            own: list = [None] * len(f)
            for at, row in zip(np.flatnonzero(f), rows, strict=True):
                own[at] = None if np.isnan(row[0]) else row[:r]
            out.append(own)
        return pd.Series(out)

    cut = blocks(smoothed, ["setpoint", "gyro"], sized).select(*KEYS, "k0", F.posexplode(solve("setpoint", "gyro", "resp", *_SHAPE)).alias("j", "response"))
    return cut.where("response is not null").select(*KEYS, (F.col("k0") + F.col("j")).alias("k"), "response")


def step_response(signal: DataFrame, min_input: float = 20.0, duration_ms: float = 500.0, segment_ms: float = 2000.0, smooth: int = 1) -> DataFrame:
    """(keys, i, time_ms, mean, std, n_segments): mean and spread over segments; zeros for a log without a usable segment."""
    rows = step_segments(signal, min_input, duration_ms, segment_ms, smooth).select(*KEYS, F.posexplode("response").alias("i", "v"))
    found = rows.groupBy(*KEYS, "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n_segments"))
    size = F.floor(F.lit(duration_ms) * F.col("rate_khz")).cast("bigint")
    fits = signal.groupBy(*KEYS).agg(F.first("rate_khz").alias("rate_khz")).withColumn("size", size).where((F.col("size") >= 2) & (F.floor(F.lit(segment_ms) * F.col("rate_khz")) >= 2 * F.col("size")))
    grid = fits.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1))).select(*KEYS, F.col("i").cast("int").alias("i"), (F.col("i") * duration_ms / (F.col("size") - 1)).alias("time_ms"))
    return grid.join(found, [*KEYS, "i"], "left").select(*KEYS, "i", "time_ms", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def compare_responses(signals: DataFrame, catalog: DataFrame, least: int = 100) -> DataFrame:
    """Step responses of visible logs inside their ranges, at each log's median rate; axes with fewer than ``least`` rows are left out.

    ``signals`` is (log_id, frame_seq, axis, time_s, setpoint, gyro).  The rows in range are stored: five steps read them, and what makes
    them, sorts included, runs once.
    """
    from aerolytics.operators.frames import in_range
    from aerolytics.operators.stats import median_rate

    kept = stored(in_range(signals, catalog).select(*KEYS, "frame_seq", "time_s", "setpoint", "gyro"))
    one = kept.groupBy("log_id", "frame_seq").agg(F.first("time_s").alias("time_s"))
    size = kept.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min("frame_seq").alias("_first")).where(F.col("_n") >= least)
    sides = size.join(median_rate(one).select("log_id", "rate_khz"), "log_id")
    rated = attach(kept, sides, KEYS)
    return step_response(rated.select(*KEYS, (F.col("frame_seq") - F.col("_first")).alias("i"), "setpoint", "gyro", "rate_khz"))
