"""Delays at each log's own rate, and transforms of signals larger than a task, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolytics.operators import delays

SIGNAL = "log_id long, axis string, i long, rate double, raw double, filt double"


def pair(seed, n, shift):
    dice = np.random.default_rng(seed)
    raw = np.cumsum(dice.normal(size=n)) * 0.1 + dice.normal(size=n)
    return raw, np.roll(np.convolve(raw, np.ones(5) / 5, "same"), shift) + 0.05 * dice.normal(size=n)


def frame(spark, logs):
    rows = [(log, "roll", i, rate, float(a), float(b)) for log, (rate, raw, filt) in logs.items() for i, (a, b) in enumerate(zip(raw, filt, strict=True))]
    return spark.createDataFrame(rows, SIGNAL).repartition(6)


def plain_lag(raw, filt, rate, max_delay_ms):
    r, f = (raw - raw.mean()) / raw.std(), (filt - filt.mean()) / filt.std()
    most = min(int(max_delay_ms * rate / 1000.0), len(r) // 2)
    return int(np.argmax([float(r[: len(r) - k] @ f[k:]) for k in range(most + 1)]))


def test_each_log_has_lags_of_its_rate_and_long_logs_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(delays, "BLOCK", 256)
    logs = {1: (8_000.0, *pair(1, 9_000, 300)), 2: (1_000.0, *pair(2, 700, 37)), 3: (100.0, *pair(3, 50, 4)), 4: (4_000.0, *pair(4, 12, 2))}
    found = {r.log_id: (r.lag, r.delay_ms) for r in delays.correlation_delay(frame(spark, logs), "raw", "filt", None, 100.0).collect()}
    lags = {log: plain_lag(raw, filt, rate, 100.0) for log, (rate, raw, filt) in logs.items()}
    assert lags[1] > 250 and found == {log: (lags[log], lags[log] / logs[log][0] * 1000.0) for log in logs}


def plain_phase(raw, filt, rate, low, high):
    x, y, freq = np.fft.rfft(raw), np.fft.rfft(filt), np.fft.rfftfreq(len(raw), 1.0 / rate)
    kept = (freq >= low) & (freq <= high) & (np.abs(x) > np.abs(x).max() * 1e-6)
    if len(raw) < 64 or kept.sum() < 3:
        return 0.0
    return max(0.0, -np.polyfit(freq[kept], np.unwrap(np.angle(y[kept] / x[kept])), 1)[0] / (2 * np.pi) * 1000)


@pytest.mark.parametrize("whole, group", [(1 << 20, 1 << 18), (0, 64), (1_000, 1_024)])
def test_phase_of_signals_of_any_length(spark, whole, group):
    sizes = {1: 64, 2: 127, 3: 1_009, 4: 1_024, 5: 2_310, 6: 63, 7: 3_001}  # primes and powers of two among them
    logs = {log: (1_000.0 * log, *pair(log, n, 3)) for log, n in sizes.items()}
    found = {r.log_id: r.delay_ms for r in delays.phase_delay(frame(spark, logs), "raw", "filt", None, 50.0, 400.0, whole=whole, group=group).collect()}
    assert found == {log: pytest.approx(plain_phase(raw, filt, rate, 50.0, 400.0), rel=1e-9, abs=1e-9) for log, (rate, raw, filt) in logs.items()}


def test_groups_of_a_long_transform_are_bounded(spark):
    """The rows of one long signal meet in groups of a few thousand numbers."""
    n, group = 20_011, 4_096
    raw, filt = pair(9, n, 5)
    signal = frame(spark, {1: (4_000.0, raw, filt)}).select("log_id", "axis", F.lit(n).cast("long").alias("n"), "rate", "i", F.col("raw").alias("r"), F.col("filt").alias("f"))
    parts = delays.long_transforms(signal, 50.0, 500.0, group)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("here#") > 3
    shape = delays._Plan(n, group)
    assert shape.rows * shape.C <= group and shape.columns * shape.R <= group and shape.P >= 2 * n - 1
    x = np.fft.rfft(raw)
    found = sorted((q.freq, complex(q.xr, q.xi)) for r in parts.collect() for q in r.found)
    freq = np.fft.rfftfreq(n, 1 / 4_000.0)
    kept = (freq >= 50) & (freq <= 500)
    assert [f for f, _ in found] == pytest.approx(freq[kept].tolist(), rel=1e-12)
    assert np.abs(np.array([v for _, v in found]) - x[kept]).max() < 1e-9 * np.abs(x).max()
    assert parts.agg(F.max("top")).head()[0] == pytest.approx(np.abs(x).max(), rel=1e-9)
    assert parts.count() == shape.R // shape.rows == 16


def test_empty_and_constant_signals(spark):
    empty = frame(spark, {1: (100.0, *pair(1, 20, 1))}).where("false")
    assert delays.phase_delay(empty, "raw", "filt").count() == 0 and delays.correlation_delay(empty, "raw", "filt").count() == 0
    flat = frame(spark, {1: (1_000.0, np.ones(80), np.arange(80.0)), 2: (1_000.0, np.zeros(70), np.zeros(70))})
    assert {r.delay_ms for r in delays.correlation_delay(flat, "raw", "filt").collect()} == {0.0}
    assert {r.delay_ms for r in delays.phase_delay(flat, "raw", "filt").collect()} == {0.0}


@pytest.mark.parametrize("n", [140, 195, 460, 560, 600, 660])
def test_bands_hold_frequencies_at_their_ends(n):
    """5 and 40 Hz at 100 Hz, where they are frequencies of the transform."""
    freq = [k * 100.0 / n for k in range(n // 2 + 1)]
    inside = [k for k, f in enumerate(freq) if 5 <= f <= 40]
    assert delays._band(n, 100.0, 5.0, 40.0) == (inside[0], inside[-1])


def test_a_signal_whose_transform_fits_a_group_is_not_cut(spark, monkeypatch):
    cut, whole = [], delays.long_transforms
    monkeypatch.setattr(delays, "long_transforms", lambda signal, *args: cut.append(signal.select("log_id").distinct()) or whole(signal, *args))
    logs = {log: (1_000.0, *pair(log, n, 3)) for log, n in {1: 500, 2: 601, 3: 1_024, 4: 1_300}.items()}
    found = {r.log_id: r.delay_ms for r in delays.phase_delay(frame(spark, logs), "raw", "filt", None, 50.0, 400.0, whole=550, group=2_048).collect()}
    assert found == {log: pytest.approx(plain_phase(raw, filt, rate, 50.0, 400.0), rel=1e-9, abs=1e-9) for log, (rate, raw, filt) in logs.items()}
    assert {r.log_id for r in cut[0].collect()} == {4}
