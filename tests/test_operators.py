import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolytics.operators import frames as fr
from aerolytics.operators import kernels
from aerolytics.operators import spectral as sp
from aerolytics.operators import stats


def signal(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"log_id": 1, "axis": "roll", "i": np.arange(n), **{k: np.asarray(v, float) for k, v in columns.items()}})
    return spark.createDataFrame(pdf)


def test_pid_error_and_sum(spark):
    df = spark.createDataFrame([(100.0, 100.0, 10.0, 1.0, 0.5, 0.1), (200.0, 190.0, 20.0, 2.0, 1.0, 0.2), (300.0, 310.0, 0.0, 0.0, 0.0, None)], "gyro double, setpoint double, p double, i double, d double, f double")
    assert [r.e for r in df.select(stats.pid_error().alias("e")).collect()] == [0, 10, -10]
    c = F.col
    assert [r.s for r in df.select(stats.pid_sum(c("p"), c("i"), c("d"), c("f")).alias("s")).collect()] == pytest.approx([11.6, 23.2, 0.0])
    assert [r.s for r in df.select(stats.pid_sum(c("p"), c("i")).alias("s")).collect()] == [11, 22, 0]


def test_sticks(spark):
    df = spark.createDataFrame([(1, x) for x in (0.0, 250.0, -500.0, 500.0, 600.0, float("nan"))], "log_id long, rc double").withColumn("pct", stats.rc_percent(F.col("rc")))
    shares, moments = stats.stick_distribution(df, ["log_id"])
    assert {r.bin: r.fraction for r in shares.collect()} == {0: 0.25, 50: 0.25, 99: 0.5}
    values = np.array([0, 50, 100, 100, 120])
    assert moments.head().mean == pytest.approx(values.mean()) and moments.head().std == pytest.approx(values.std())


def test_error_by_stick_equals_numpy(spark):
    rng = np.random.default_rng(42)
    sp_, gy = rng.integers(-400, 400, 500), rng.integers(-1500, 1500, 500)
    df = spark.createDataFrame(pd.DataFrame({"log_id": 1, "axis": "roll", "setpoint": sp_, "gyro": gy})).repartition(5)
    rows = {r.bin: r for r in stats.error_by_stick(df).collect()}
    err, top = gy - sp_, np.abs(sp_).max()
    for i, t in enumerate(np.linspace(0.1, 1.0, 10)):
        part = np.abs(err[(np.abs(sp_) < top * t) & (np.abs(err) < 1000)])
        assert rows[i].mean_abs == pytest.approx(part.mean()) and rows[i].se == pytest.approx(part.std() / np.sqrt(len(part)))
    zero = df.withColumn("setpoint", F.lit(0))
    assert all(r.mean_abs == 0 and r.se == 0 for r in stats.error_by_stick(zero).collect())


def test_error_histogram_edges(spark):
    df = spark.createDataFrame([(1, "roll", g, 0) for g in (1000, 999, -1000, 1001, 5, 5)], "log_id long, axis string, gyro long, setpoint long")
    rows = {r.bin: (r["count"], r.normalized) for r in stats.error_histogram(df).collect()}
    assert rows == {1999: (2, 1.0), 0: (1, 0.5), 1005: (2, 1.0)}


def test_motor_range_rules(spark):
    df = spark.createDataFrame([(1, 0, 1000), (1, 1, 1400)], "log_id long, frame_seq long, motor_0 long")
    r = stats.motor_statistics(df).head()
    assert (r.mean, r.low, r.high) == (60.0, 50.0, 70.0)
    flat = spark.createDataFrame([(1, 1000, 1000)], "log_id long, motor_output_low int, motor_output_high int")
    assert stats.motor_statistics(df, flat).head().high == 40000.0


def test_summary_uses_row_order(spark):
    df = spark.createDataFrame([(1, 0, 5_000_000), (1, 1, 9_000_000), (1, 2, 7_000_000), (2, 0, 1)], "log_id long, frame_seq long, time long")
    rows = {r.log_id: (r.n, r.duration_s, r.sample_rate_hz) for r in stats.log_summary(df).collect()}
    assert rows == {1: (3, 2.0, 1.0), 2: (1, 0.0, 0.0)}


def plain_fold(kinds, iterations, times, raw=False):
    """The rules, one after the other, with 32-bit times."""
    valid, li, lt, added, out = False, -1, -1, 0, []
    for k, i, t in zip(kinds, iterations, times):
        if k == "E":
            break
        if k in "IP":
            if lt != -1 and t < lt % 2**32 and (t - lt) % 2**32 < 10_000_000:
                added += 2**32
            t += added
            ok = raw or li == -1 or (i >= li and i < li + 5000 and t >= lt and t < lt + 10_000_000)
            valid = ok if k == "I" else (valid and ok)
            out.append((valid, t))
            if valid:
                li, lt = i, t
        elif k == "R":
            li, lt = i, t + added
        elif k == "?":
            valid = False
    return out


@pytest.mark.parametrize("raw", [False, True])
def test_validity_equals_rules_in_one_go_and_in_parts(spark, raw):
    rng = np.random.default_rng(7)
    rows = []
    for log in range(6):
        i, t = 0, 2**32 - 60_000 * log
        for s in range(400):
            kind = rng.choice(list("IPPPPPR?BG"), p=[0.1, 0.3, 0.2, 0.2, 0.1, 0.04, 0.02, 0.02, 0.01, 0.01])
            i, t = i + int(rng.integers(-1 if rng.random() < 0.1 else 0, 40)) * (200 if rng.random() < 0.03 else 1), t + int(rng.integers(0, 1000))
            rows.append((log, s, str(kind if s != 380 else "E"), max(i, 0), (t if rng.random() > 0.01 else int(rng.integers(0, 2**32))) % 2**32))
    df = spark.createDataFrame(rows, "log_id long, stream_seq long, kind string, iteration long, time32 long").repartition(4)
    found = {(r.log_id, r.stream_seq): (r.valid, r.time) for r in fr.validate_logs(df, raw).collect() if r.valid is not None}
    for log in range(6):
        own = [r for r in rows if r[0] == log]
        assert [v for k, v in sorted(found.items()) if k[0] == log] == plain_fold(*zip(*[r[2:] for r in own]), raw=raw)
    kind, iteration, time = [np.array(x) for x in zip(*[r[2:] for r in rows if r[0] == 3])]
    whole, parts = fr.Fold(raw=raw), fr.Fold(raw=raw)
    a = whole.run(kind, iteration, time)
    cuts = [0, 1, 2, 50, 51, 120, 399, 400]
    b = [parts.run(kind[x:y], iteration[x:y], time[x:y]) for x, y in zip(cuts, cuts[1:])]
    assert (np.concatenate([x for x, _ in b]) == a[0]).all() and (np.concatenate([t for _, t in b]) == a[1]).all() and whole == parts


def test_a_corrupt_time_is_no_rollover(spark):
    rows = [(1, 0, "I", 0, 1_000_000), (1, 1, "P", 1, 4_294_967_290), (1, 2, "I", 2, 1_020_000), (1, 3, "P", 3, 1_030_000)]
    df = spark.createDataFrame(rows, "log_id long, stream_seq long, kind string, iteration long, time32 long")
    assert [(r.time, r.valid) for r in sorted(fr.validate_logs(df).collect())] == [(1_000_000, True), (4_294_967_290, False), (1_020_000, True), (1_030_000, True)]


def test_rebuild_by_frame_type(spark):
    rows = [(1, 0, "P", 7, 7, 7, 7), (1, 1, "I", 100, 5, 4_294_967_290, 5), (1, 2, "P", 3, 1, 10, 2), (1, 3, "P", -1, 0, 3_000_000_000, 3), (1, 4, "I", 50, 0, 3_000_000_000, -9), (1, 5, "P", 0, 0, 1, 4)]
    df = spark.createDataFrame(rows, "log_id long, stream_seq long, frame_type string, motor_0 long, m long, u long, a long").selectExpr("*", "1000 as minthrottle")
    rules = {"m": fr.FieldRule("motor_0", "motor_0"), "motor_0": fr.FieldRule("minthrottle", "previous"), "u": fr.FieldRule(signed=False), "a": fr.FieldRule(p="average_2")}
    found = sorted((r.stream_seq, r.motor_0_value, r.m_value, r.u_value, r.a_value) for r in fr.rebuild(df, rules).collect())
    assert found == [(0, 7, 14, 7, 7), (1, 1100, 1105, 4_294_967_290, 5), (2, 1103, 1104, 4, 7), (3, 1102, 1102, 3_000_000_004, 9), (4, 1050, 1050, 3_000_000_000, -9), (5, 1050, 1050, 3_000_000_001, -5)]
    wide = fr.rebuild(df, {"u": fr.FieldRule(wraps=False)}).orderBy("stream_seq").collect()
    assert [r.u_value for r in wide][3] == 4_294_967_290 + 10 + 3_000_000_000
    with pytest.raises(ValueError):
        fr.rebuild(df, {"u": fr.FieldRule(i="previous")})


def test_rules_from_field_definitions(spark):
    rows = [(log, t, p, n, s, w, q, e) for log in (1, 2) for t, p, n, s, w, q, e in (("I", 0, "motor_0", 0, 4, 4, 1), ("P", 0, "motor_0", 0, 4, 1, 0), ("I", 1, "g", 1, 8, 0, 0), ("P", 1, "g", 1, 8, 3, 0))]
    defs = spark.createDataFrame(rows, "log_id long, frame_type string, pos int, name string, signed int, width int, predictor int, encoding int")
    (only,) = fr.field_rules(defs).collect()
    assert fr.rules_of(only.fields) == {"motor_0": fr.FieldRule("minthrottle", "previous", False, True), "g": fr.FieldRule("zero", "average_2", True, False)}


def test_statistics_of_partial_logs(spark):
    full = spark.createDataFrame([(1, 0, 0, 500, 100, 40, 1000), (1, 1, 1_000_000, -250, -200, 60, 1400), (2, 0, 5, 1, 1, 1, 1)], "log_id long, frame_seq long, time long, rc_roll long, setpoint_roll long, throttle long, motor_1 long")
    rows = {r.log_id: r for r in stats.flight_statistics(full).collect()}
    r = rows[1]
    assert (r.n, r.duration_s, r.sample_rate_hz, r.sticks["roll"].mean, list(r.sticks), r.throttle.mean, r.pid_error) == (2, 1.0, 1.0, 75.0, ["roll"], 50.0, {})
    assert [(m.motor, m.mean, m.low, m.high) for m in r.motors] == [(1, 60.0, 50.0, 70.0)]
    r = rows[2]
    assert (r.duration_s, r.sample_rate_hz, r.sticks, r.throttle, r.motors, r.pid_error) == (0.0, 0.0, {}, None, None, {})
    bare = full.select("log_id", "frame_seq")
    assert {(r.n, r.duration_s, r.motors) for r in stats.flight_statistics(bare).collect()} == {(2, 0.0, None), (1, 0.0, None)}
    for empty in (stats.long_signals(bare), stats.stick_percent(bare), stats.motor_statistics(bare), stats.throttle_percent(bare), stats.flight_histograms(bare), fr.log_signals(bare), stats.error_by_stick(stats.long_signals(bare))):
        assert empty.count() == 0
    assert fr.active_range(full).count() == 2  # pitch and yaw setpoints are absent
    shares = {(r.signal, r.bin): r.fraction for r in stats.flight_histograms(full.withColumn("throttle", F.col("throttle") * 10)).where("log_id = 1").collect()}
    assert shares == {("roll", 99): 0.5, ("roll", 50): 0.5, ("throttle", 40): 0.5, ("throttle", 60): 0.5}


def test_document_of_partial_logs(spark):
    from aerolytics.plans.analysis import analyze_logs

    frames = spark.createDataFrame([(1, 0, 5), (1, 1, 7)], "log_id long, frame_seq long, gyro_roll long")
    config = spark.createDataFrame([(1, "Betaflight 4.5.1", "4.5.1", 48, 2047)], "log_id long, firmware_revision string, fc_version string, motor_output_low int, motor_output_high int")
    d = analyze_logs(frames, config).head().document
    assert (d.duration_s, d.stick_distributions, d.pid_error, d.motor_stats, d.valid_frames, d.firmware) == (0.0, {}, {}, None, 2, "Betaflight 4.5.1")


def test_rolling_rms_over_many_spans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 700
    x = np.round(rng.normal(0, 200, n), 1)
    df = spark.createDataFrame(pd.DataFrame({"log_id": 1, "frame_seq": np.arange(n), "time": np.arange(n) * 10_000, "setpoint_roll": x})).repartition(3)
    win = int(0.5 / np.median(np.diff(np.arange(n) * 10_000 / 1e6)))
    expected = np.sqrt(np.convolve(x**2, np.ones(win) / win, mode="same"))
    for span in (16_384, 100, 30):
        monkeypatch.setattr(fr, "SPAN", span)
        got = np.array([r.rms for r in sorted(fr.rolling_rms(df).select("frame_seq", "rms").collect())])
        assert np.allclose(got, expected)


def exchanges(df):
    """Columns by which rows are shuffled, for every exchange of the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange SinglePartition" in line]


def test_values_of_a_log_reach_frames_without_shuffling_them(spark, tmp_path):
    rows = [(log, i, i * 10_000, float(i % 7), float(i % 5), i % 90) for log in range(3) for i in range(60)]
    spark.createDataFrame(rows, "log_id long, frame_seq long, time long, gyro_roll double, setpoint_roll double, throttle long").write.parquet(str(tmp_path / "frames"))
    frames = spark.read.parquet(str(tmp_path / "frames"))
    config = frames.select("log_id").distinct().selectExpr("log_id", "32 as i_interval", "1 as p_num", "2 as p_denom")
    catalog = frames.select("log_id").distinct().selectExpr("log_id", "0.0D as time_start_s", "1.0D as time_end_s", "true as visible")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        timed = fr.relative_time(frames)
        for df in (timed, fr.in_range(timed, catalog), fr.preview(frames, 10), stats.throttle_percent(frames), fr.skipped_after(frames.withColumn("loop_iteration", F.col("frame_seq")), config)):
            assert not exchanges(df)
        by_stick = stats.error_by_stick(stats.long_signals(frames))
        lines = by_stick._jdf.queryExecution().executedPlan().toString().splitlines()
        below = {x.split("axis")[1][:20]: lines[i + 1] for i, x in enumerate(lines) if x in exchanges(by_stick)}
        assert len(below) == 2  # partial moments by stick, and then their small table
        assert all("HashAggregate" in x and "stick" in x for x in below.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_sides_are_dealt_to_chunks(spark):
    from aerolytics.operators.attach import attach

    frames = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 5).cast("long").alias("log_id"), F.col("id").alias("frame_seq")).repartition(3)
    side = frames.groupBy("log_id").agg(F.max("frame_seq").alias("top"))
    small, large = attach(frames, side), attach(frames, side, limit=0, rows=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_part" in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)  # the hot log spreads by chunk
    left = attach(frames, side.where("log_id <> 1"), how="left", limit=0, rows=100)
    assert left.count() == 5000 and left.where("top is null").count() == frames.where("log_id = 1").count()


@pytest.mark.parametrize("rows", [16_384, 64])
def test_blocks_of_any_size_give_the_same_segments(spark, rows):
    n = 403
    base = signal(spark, x=np.arange(n) * 1.0)
    sized = sp.layout(base).selectExpr("*", "50L as size", "20L as hop", "17L as last", "0L as shift")
    found = {r.k: list(r.x) for r in sp.segments(base, ["x"], sized, rows).collect()}
    assert found == {k: [float(v) for v in range(k * 20, k * 20 + 50)] for k in range(18)}


def test_welch_finds_the_tone_and_equals_a_plain_transform(spark):
    rate, n = 4000.0, 2000
    x = np.sin(2 * np.pi * 200 * np.arange(n) / rate)
    found = sp.welch(signal(spark, x=x, rate=np.full(n, rate)))
    assert abs(sp.spectral_peak(found).head().freq - 200) < 20
    assert sp.welch(signal(spark, x=x[:2], rate=np.full(2, rate))).count() == 0
    size = 500
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = []
    for s in range(0, n - size + 1, size // 2):
        y = (x[s : s + size] - x[s : s + size].mean()) * w
        p = np.abs(np.array([np.sum(y * np.exp(-2j * np.pi * k * np.arange(size) / size)) for k in range(size // 2 + 1)])) ** 2
        p[1:-1] *= 2
        power.append(p / w.sum() ** 2)
    rows = sorted((r.bin, r.amplitude) for r in found.collect())
    assert np.allclose([a for _, a in rows], np.sqrt(np.mean(power, axis=0)))


def test_step_response_of_a_lag(spark):
    rate = 1.0
    n = 5000
    setpoint = 300 * np.sign(np.sin(2 * np.pi * np.arange(n) / 800))
    gyro = np.zeros(n)
    for i in range(1, n):
        gyro[i] = gyro[i - 1] + (setpoint[i] - gyro[i - 1]) / 20
    rows = sorted((r.i, r.mean, r.n_segments) for r in sp.step_response(signal(spark, setpoint=setpoint, gyro=gyro, rate_khz=np.full(n, rate))).collect())
    assert len(rows) == 500 and rows[0][2] == len(range(0, n - 2000, 1000))
    assert 0.8 < np.mean([m for _, m, _ in rows[-125:]]) < 1.2
    quiet = sp.step_response(signal(spark, setpoint=np.zeros(n), gyro=np.zeros(n), rate_khz=np.full(n, rate)))
    assert all(r.mean == 0 and r.n_segments == 0 for r in quiet.collect())


def test_correlation_delay(spark):
    rng = np.random.default_rng(42)
    raw = rng.normal(size=4000)
    shifted = np.concatenate((np.zeros(8), raw[:-8]))
    r = sp.correlation_delay(signal(spark, raw=raw, filt=shifted), "raw", "filt", 4000.0).head()
    assert (r.lag, r.delay_ms) == (8, 2.0)
    assert sp.correlation_delay(signal(spark, raw=raw[:9], filt=raw[:9]), "raw", "filt", 4000.0).head().delay_ms == 0
    assert sp.correlation_delay(signal(spark, raw=np.ones(50), filt=raw[:50]), "raw", "filt", 4000.0).head().delay_ms == 0


def test_phase_delay_golden(spark):
    rng = np.random.default_rng(42)
    raw = rng.normal(size=4000)
    smooth = np.convolve(raw, np.ones(9) / 9, mode="same")
    got = sp.phase_delay(signal(spark, raw=raw, filt=smooth), "raw", "filt", 4000.0, 50.0, 500.0).head().delay_ms
    x, y, f = np.fft.rfft(raw), np.fft.rfft(smooth), np.fft.rfftfreq(4000, 1 / 4000)
    keep = (f >= 50) & (f <= 500) & (np.abs(x) > 1e-6 * np.abs(x).max())
    expected = max(0.0, -np.polyfit(f[keep], np.unwrap(np.angle(y[keep] / x[keep])), 1)[0] / (2 * np.pi) * 1000)
    assert got == pytest.approx(expected, rel=1e-9)
    assert sp.phase_delay(signal(spark, raw=raw[:63], filt=raw[:63]), "raw", "filt", 4000.0).head().delay_ms == 0


def test_windows_and_periodogram():
    for name in ("hann", "hamming", "blackman", "boxcar"):
        assert kernels.window(name, 8).shape == (8,)
    with pytest.raises(ValueError):
        kernels.window("none", 8)
    rows = np.random.default_rng(1).normal(size=(3, 9))
    p = kernels.periodogram(rows, np.full(3, 2.0), "boxcar")
    centred = rows - rows.mean(axis=1, keepdims=True)
    assert np.allclose(p.sum(axis=1), (centred**2).sum(axis=1) / 2.0)


def test_repartitioning_changes_nothing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1200)
    base = signal(spark, x=x, rate=np.full(1200, 100.0))
    a = sorted((r.bin, round(r.amplitude, 12)) for r in sp.welch(base).collect())
    b = sorted((r.bin, round(r.amplitude, 12)) for r in sp.welch(base.repartition(7).orderBy(F.rand(3))).collect())
    assert a == b


@pytest.mark.parametrize("bins", [1, 4, 10])
def test_stick_bins_and_axes_can_be_chosen(spark, bins):
    rng = np.random.default_rng(2)
    rows = [(1, axis, i, float(rng.normal(scale=300)), float(rng.integers(-400, 401))) for axis in ("roll", "pitch") for i in range(300)]
    df = spark.createDataFrame(rows, "log_id long, axis string, i long, gyro double, setpoint double")
    (report,) = stats.error_report(df, num_bins=bins, axes=["roll"]).collect()
    own = np.array([(g, s) for _, axis, _, g, s in rows if axis == "roll"])
    error, stick = np.abs(own[:, 0] - own[:, 1]), np.abs(own[:, 1])
    kept = [error[(stick < stick.max() * t) & (error < 1000)] for t in np.linspace(0.1, 1.0, bins)]
    assert report.axis == "roll" and np.allclose(report.mean_abs, [k.mean() for k in kept], rtol=1e-12)
    assert np.allclose(report.se, [k.std() / np.sqrt(len(k)) for k in kept], rtol=1e-9) and np.isclose(report.std_dev, np.std(own[:, 0] - own[:, 1]), rtol=1e-9)
