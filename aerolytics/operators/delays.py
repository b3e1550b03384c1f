"""Delays of filters at each log's own rate, by correlation and by the slope of the phase.

Correlation: the rows of a log and axis are dealt to blocks with the rows that the largest lag reaches beyond them; a block's
correlations at all lags come from one pair of transforms, and blocks add up.  Phase: signals of up to ``WHOLE`` rows are transformed in
one go, and so are those whose transform is one group; a longer one, of any length, is transformed by Spark in three shuffles of bounded groups (``long_transforms``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from aerolytics.operators.attach import attach
from aerolytics.ship import ship

KEYS = ["log_id", "axis"]
#: Rows of a signal that one task transforms as a whole.
WHOLE = 1 << 20
#: Complex numbers of a group of a long transform.
GROUP = 1 << 18
#: Rows of a block that is correlated at once, at least.
BLOCK = 4_096


def rated(signal: DataFrame, rate_hz: float | None) -> DataFrame:
    """The signal with a column ``rate``: the given one for all logs, or its own."""
    return signal if rate_hz is None else signal.withColumn("rate", F.lit(float(rate_hz)))


# ---- correlation ----


def correlation_delay(signal: DataFrame, raw: str, filtered: str, rate_hz: float | None = None, max_delay_ms: float = 10.0, digits: int | None = None) -> DataFrame:
    """(keys, lag, delay_ms) of the largest correlation of ``filtered`` with ``raw`` at lags from 0; the smallest lag among equals.

    0 for fewer than ten rows or a constant signal.  Without ``rate_hz`` each log has the rate of its column ``rate``, and
    so its own range of lags.  ``digits`` rounds the correlations before they are compared, so that sums in another order give the same lag.
    """
    from aerolytics.operators.spectral import _cut, blocks

    ship(signal.sparkSession)
    held = rated(signal, rate_hz).select(*KEYS, "i", "rate", F.col(raw).cast("double").alias("r"), F.col(filtered).cast("double").alias("f"))
    moments = [fn(c).alias(f"{c}_{name}") for c in "rf" for fn, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    shapes = held.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("rate").alias("rate"), *moments)
    most = F.least((F.lit(max_delay_ms) * F.col("rate") / 1000.0).cast("int").cast("bigint"), F.floor(F.col("n") / 2))
    sized = shapes.where("n >= 10 and r_std >= 1e-10 and f_std >= 1e-10").withColumn("most", most).withColumn("hop", F.greatest(F.lit(BLOCK).cast("bigint"), 2 * F.col("most")))
    sized = sized.withColumns({"size": F.col("hop") + F.col("most"), "last": F.floor((F.col("n") - 1) / F.col("hop")), "shift": F.lit(0).cast("bigint")})

    @F.pandas_udf("array<double>")
    def correlate(r: pd.Series, f: pd.Series, scale: pd.DataFrame, most: pd.Series, *shape: pd.Series) -> pd.Series:
        out = []
        for a, b, rm, rs, fm, fs, lags, i, k0, m, size, hop, shift in zip(r, f, *(scale[c] for c in ("r_mean", "r_std", "f_mean", "f_std")), most, *shape, strict=True):
            x = _cut((a - rm) / rs, i, k0, m, size, hop, shift)[:, :hop]
            y = _cut((b - fm) / fs, i, k0, m, size, hop, shift)
            width = 1 << int(size - 1).bit_length()
            product = np.conj(np.fft.rfft(x, width, axis=1)) * np.fft.rfft(y, width, axis=1)
            out.append(np.fft.irfft(product.sum(axis=0), width)[: lags + 1])
        return pd.Series(out)

    scale = F.struct("r_mean", "r_std", "f_mean", "f_std")
    parts = blocks(held, ["r", "f"], sized).select(*KEYS, F.posexplode(correlate("r", "f", scale, "most", "i", "k0", "m", "size", "hop", "shift")).alias("lag", "c"))
    sums = parts.groupBy(*KEYS, "lag").agg(F.sum("c").alias("c"))
    value = F.col("c") if digits is None else F.round("c", digits)
    best = sums.groupBy(*KEYS).agg(F.max(F.struct(value.alias("c"), (-F.col("lag")).alias("k"))).alias("b")).select(*KEYS, (-F.col("b.k")).alias("lag"))
    lag = F.coalesce("lag", F.lit(0))
    return shapes.select(*KEYS, "rate").join(best, KEYS, "left").select(*KEYS, lag.alias("lag"), (lag / F.col("rate") * 1000.0).alias("delay_ms"))


# ---- transforms ----

FOUND = "freq double, xr double, xi double, yr double, yi double"


def _band(n: int, rate: float, low: float, high: float) -> tuple[int, int]:
    """The first and last number of a transform's frequencies inside the range; the last is smaller if there are none."""
    first = max(int(np.ceil(low * n / rate)) - 1, 0)
    while first * rate / n < low:
        first += 1
    last = min(int(high * n / rate) + 1, n // 2)
    while last >= 0 and last * rate / n > high:
        last -= 1
    return first, last


def _found(k: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, rate: float) -> list[dict]:
    names = ("freq", "xr", "xi", "yr", "yi")
    return [dict(zip(names, row, strict=True)) for row in zip((k * rate / n).tolist(), x.real.tolist(), x.imag.tolist(), y.real.tolist(), y.imag.tolist(), strict=True)]


def whole_transforms(signal: DataFrame, low: float, high: float, whole: int = WHOLE, group: int = GROUP) -> DataFrame:
    """(keys, top, found) of signals (keys, i, n, rate, r, f) that fit a task; beyond ``whole`` rows by the steps of a long transform in one group."""
    kind = dict(signal.dtypes)["log_id"]
    made = f"log_id {kind}, axis string, top double, found array<struct<{FOUND.replace(' double', ':double')}>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n, rate = table["n"][0].as_py(), table["rate"][0].as_py()
        r, f = table["r"].to_numpy(), table["f"].to_numpy()
        x, y = (np.fft.rfft(r), np.fft.rfft(f)) if n <= whole else _Plan(n, group).transforms(r, f)
        a, b = _band(n, rate, low, high)
        k = np.arange(a, b + 1)
        return pa.Table.from_pylist([{"log_id": table["log_id"][0].as_py(), "axis": table["axis"][0].as_py(), "top": float(np.abs(x).max()), "found": _found(k, x[k], y[k], n, rate)}], schema=schema)

    schema = _arrow(made)
    return signal.groupBy(*KEYS).applyInArrow(run, made)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _bits() -> Column:
    """The power of two that a long transform of ``n`` rows takes."""
    return F.ceil(F.log2(F.col("n") * 2 - 1)).cast("int")


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


class _Plan:
    """Sizes of a long transform: P = R * C is a power of two of at least 2n - 1."""

    def __init__(self, n: int, group: int):
        bits = (2 * n - 2).bit_length()
        self.n, self.P, self.R, self.C = n, 1 << bits, 1 << (bits // 2), 1 << (bits - bits // 2)
        self.rows, self.columns = max(1, min(self.R, group // self.C)), max(1, min(self.C, group // self.R))

    def chirp(self, j: np.ndarray) -> np.ndarray:
        return np.exp(-1j * np.pi * ((j * j) % (2 * self.n)) / self.n)

    def filter(self, j: np.ndarray) -> np.ndarray:
        """The chirp that the sequence is convolved with, at places modulo P."""
        back = np.minimum(j, self.P - j)
        return np.where(back < self.n, np.conj(self.chirp(back)), 0)

    def turn(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (a * b) / self.P)

    def transforms(self, *signals: np.ndarray) -> list[np.ndarray]:
        """The transforms of whole signals up to half their length, where P is no more than a group: convolved with the chirp at once."""
        chirp = self.chirp(np.arange(self.n))
        against = np.fft.fft(self.filter(np.arange(self.P)))
        return [(np.fft.ifft(np.fft.fft(s * chirp, self.P) * against)[: self.n] * chirp)[: self.n // 2 + 1] for s in signals]


def long_transforms(signal: DataFrame, low: float, high: float, group: int = GROUP) -> DataFrame:
    """(keys, top, found) of signals of any length, no group of more than about ``group`` numbers.

    The transform of n rows is a convolution with a chirp, of which a length P = R * C that splits is free to choose.
    The sequence at places j = r + R*c is transformed over c for each r, turned, and then over r for each column; there the
    transforms of the sequences are multiplied by the chirp's, and the way back begins in the same groups: over
    the columns' numbers, turned, and over the columns.
    """
    kind = dict(signal.dtypes)["log_id"]
    piece = f"log_id {kind}, axis string, n long, rate double, here long, there long, data binary"
    made = f"log_id {kind}, axis string, top double, found array<struct<{FOUND.replace(' double', ':double')}>>"
    pieces, found = _arrow(piece), _arrow(made)
    planned = signal.withColumn("_bits", _bits())
    r_size, c_size = _power(F.floor(F.col("_bits") / 2)), _power(F.ceil(F.col("_bits") / 2))
    rows = F.greatest(F.lit(1), F.least(r_size, F.floor(F.lit(group) / c_size)))
    dealt = planned.withColumn("here", F.floor((F.col("i") % r_size) / rows))

    def head(table: pa.Table) -> dict:
        return {c: table[c][0].as_py() for c in ("log_id", "axis", "n", "rate")}

    def cut(own: dict, plan: _Plan, here: int, values: list[np.ndarray], size: int) -> pa.Table:
        """A row for each run of ``size`` columns of the matrices."""
        out = [own | {"here": at // size, "there": here, "data": np.stack([v[:, at : at + size] for v in values]).tobytes()} for at in range(0, values[0].shape[1], size)]
        return pa.Table.from_pylist(out, schema=pieces)

    def joined(table: pa.Table, count: int, rows: int, columns: int) -> list[np.ndarray]:
        """The matrices of a group: its pieces one below the other, in order."""
        parts = sorted(zip(table["there"].to_pylist(), table["data"].to_pylist(), strict=True))
        return list(np.concatenate([np.frombuffer(d, complex).reshape(count, -1, columns) for _, d in parts], axis=1)[:, :rows])

    def first(table: pa.Table) -> pa.Table:
        own, here = head(table), table["here"][0].as_py()
        plan = _Plan(own["n"], group)
        r = here * plan.rows + np.arange(plan.rows)
        i = table["i"].to_numpy()
        at = (i % plan.R - r[0]), i // plan.R
        values = []
        for name in "rf":
            a = np.zeros((plan.rows, plan.C), complex)
            a[at] = table[name].to_numpy() * plan.chirp(i)
            values.append(a)
        values.append(plan.filter(r[:, None] + plan.R * np.arange(plan.C)))
        turn = plan.turn(r[:, None], np.arange(plan.C))
        return cut(own, plan, here, [np.fft.fft(v, axis=1) * turn for v in values], plan.columns)

    def second(table: pa.Table) -> pa.Table:
        own, here = head(table), table["here"][0].as_py()
        plan = _Plan(own["n"], group)
        column = here * plan.columns + np.arange(plan.columns)
        x, y, chirp = (np.fft.fft(v, axis=0) for v in joined(table, 3, plan.R, plan.columns))
        back = np.conj(plan.turn(np.arange(plan.R)[:, None], column))
        return cut(own, plan, here, [(np.fft.ifft(v * chirp, axis=0) * back).T for v in (x, y)], plan.rows)

    def third(table: pa.Table) -> pa.Table:
        own, here = head(table), table["here"][0].as_py()
        plan = _Plan(own["n"], group)
        x, y = (np.fft.ifft(v, axis=0) for v in joined(table, 2, plan.C, plan.rows))
        k = here * plan.rows + np.arange(plan.rows) + plan.R * np.arange(plan.C)[:, None]
        kept = k <= plan.n // 2
        k, x, y = k[kept], x[kept], y[kept]
        turn = plan.chirp(k)
        x, y = x * turn, y * turn
        a, b = _band(plan.n, own["rate"], low, high)
        inside = (k >= a) & (k <= b)
        row = {"log_id": own["log_id"], "axis": own["axis"], "top": float(np.abs(x).max(initial=0.0)), "found": _found(k[inside], x[inside], y[inside], plan.n, own["rate"])}
        return pa.Table.from_pylist([row], schema=found)

    on = [*KEYS, "here"]
    one = dealt.select(*KEYS, "n", "rate", "here", "i", "r", "f").groupBy(*on).applyInArrow(first, piece)
    return one.groupBy(*on).applyInArrow(second, piece).groupBy(*on).applyInArrow(third, made)


def phase_delay(signal: DataFrame, raw: str, filtered: str, rate_hz: float | None = None, low: float = 50.0, high: float = 200.0, whole: int = WHOLE, group: int = GROUP) -> DataFrame:
    """(keys, delay_ms) from the slope of the transfer function's phase between two frequencies; 0 if it can't be told or is negative.

    Without ``rate_hz`` each log has the rate of its column ``rate``.  Frequencies with less than a millionth of the raw signal's largest
    magnitude don't count, and fewer than 64 rows tell nothing.
    """
    ship(signal.sparkSession)
    held = rated(signal, rate_hz).select(*KEYS, "i", "rate", F.col(raw).cast("double").alias("r"), F.col(filtered).cast("double").alias("f"))
    shapes = held.groupBy(*KEYS).agg(F.count("*").alias("n"))
    sized = attach(held, shapes.where("n >= 64"), KEYS, order="i")
    lone = (F.col("n") <= whole) | (_power(_bits()) <= group)  # nothing to deal to groups
    parts = whole_transforms(sized.where(lone), low, high, whole, group).unionByName(long_transforms(sized.where(~lone), low, high, group))
    tops = parts.groupBy(*KEYS).agg(F.max("top").alias("top"))
    size = F.sqrt(F.col("q.xr") * F.col("q.xr") + F.col("q.xi") * F.col("q.xi"))
    angle = F.atan2(F.col("q.yi") * F.col("q.xr") - F.col("q.yr") * F.col("q.xi"), F.col("q.yr") * F.col("q.xr") + F.col("q.yi") * F.col("q.xi"))
    each = parts.select(*KEYS, F.explode("found").alias("q")).join(tops, KEYS).where(size > F.col("top") * 1e-6)
    phases = each.select(*KEYS, F.col("q.freq").alias("freq"), angle.alias("angle"))
    line = _slopes(phases)
    delay = F.when(F.col("n") >= 3, F.greatest(F.lit(0.0), -F.col("slope") / (2 * np.pi) * 1000.0))
    return shapes.select(*KEYS).join(line, KEYS, "left").select(*KEYS, F.coalesce(delay, F.lit(0.0)).alias("delay_ms"))


def _slopes(phases: DataFrame) -> DataFrame:
    """(keys, n, slope): the phases unwrapped by frequency, and their slope."""
    order = Window.partitionBy(*KEYS).orderBy("freq")
    step: Column = F.col("angle") - F.lag("angle").over(order)
    turn = step - F.pmod(step + F.lit(np.pi), F.lit(2 * np.pi)) + F.lit(np.pi)  # whole turns of the step
    turn = F.when((F.pmod(step + F.lit(np.pi), F.lit(2 * np.pi)) == 0) & (step > 0), turn - 2 * np.pi).otherwise(turn)
    turns = phases.withColumn("turn", F.coalesce(F.when(F.abs(step) >= np.pi, turn), F.lit(0.0)))
    unwrapped = turns.withColumn("phase", F.col("angle") - F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return unwrapped.groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("phase", "freq").alias("slope"))


def filter_delays(signal: DataFrame, rate_hz: float | None, pairs: dict[str, tuple[str, str] | None], reference_hz: float = 100.0, max_delay_ms: float = 10.0, digits: int | None = None) -> DataFrame:
    """(keys, <name>_delay_ms, <name>_phase_deg ...) for pairs of raw and filtered columns; an absent pair gives 0."""
    from aerolytics.functions.units import phase_shift_degrees

    out = signal.select(*KEYS).distinct()
    for name, pair in pairs.items():
        if pair is None:
            out = out.withColumn(f"{name}_delay_ms", F.lit(0.0))
        else:
            out = out.join(correlation_delay(signal, *pair, rate_hz, max_delay_ms, digits).select(*KEYS, F.col("delay_ms").alias(f"{name}_delay_ms")), KEYS)
        out = out.withColumn(f"{name}_phase_deg", phase_shift_degrees(F.col(f"{name}_delay_ms"), F.lit(reference_hz)))
    return out
