import math

import pytest
from pyspark.sql import functions as F

from aerolytics.functions import units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_battery_and_current(spark):
    n = lambda x: F.lit(x).cast("bigint")
    assert one(spark, units.vbat_to_millivolts(n(4095), n(110))) == 36300
    assert one(spark, units.vbat_to_millivolts(n(0), n(110))) == 0
    assert one(spark, units.vbat_to_volts(n(4095), n(110))) == pytest.approx(36.3)
    assert one(spark, units.cell_count(n(4095), n(110), n(43))) == 8 + 0 if 363 >= 7 * 43 else 7
    for adc, offset, scale in ((0, 7, 400), (100, 500, 400), (2000, 0, 333), (5, 3, -250)):
        expected = ((adc * 3300) // 4095 - offset) * 10000 // scale
        assert one(spark, units.amperage_to_milliamps(n(adc), n(offset), n(scale))) == expected
    assert one(spark, units.amperage_to_milliamps(n(5), n(3), n(0))) is None


def test_simple_units(spark):
    assert one(spark, units.acceleration_to_g(F.lit(4096), F.lit(4096))) == 1.0
    assert one(spark, units.acceleration_to_g(F.lit(4096), F.lit(0))) == 0.0
    assert one(spark, units.motor_to_percent(F.lit(1500), F.lit(1000), F.lit(2000))) == 50.0
    assert one(spark, units.motor_to_percent(F.lit(1500), F.lit(7), F.lit(7))) == 0.0
    assert one(spark, units.micros_to_seconds(F.lit(2_500_000))) == 2.5
    assert one(spark, units.gyro_to_degrees(F.lit(2), F.lit(1e-6))) == pytest.approx(2 * 180 / math.pi)


def test_phase_shift_guards(spark):
    shift = lambda d, f, **k: one(spark, units.phase_shift_degrees(F.lit(d), F.lit(f), **k))
    assert shift(1.0, 1000.0) == 360.0
    assert shift(0.5, 100.0) == 18.0
    assert shift(1.0, 0.0) == 0.0
    assert shift(1.0, -100.0) == 0.0
    assert shift(1.0, -100.0, negative_is_zero=False) == -36.0


def test_rate_curve(spark):
    configs = spark.createDataFrame([(1, 1.0, 0.0, 0.7), (2, 1.0, 0.0, 0.0), (3, 2.5, 0.5, 0.7)], "log_id int, rc_rate double, rc_expo double, super_rate double")
    rows = {(r.log_id, r.rc): r.deg_s for r in units.rate_curve(configs).collect()}
    assert len(rows) == 3 * 501
    assert rows[1, 0] == 0 and rows[1, 250] < rows[1, 500] / 2
    assert rows[2, 250] == pytest.approx(100.0)
    x, rate = 0.6, 2.5 + 0.5 * 14.54
    assert rows[3, 300] == pytest.approx(200 * rate * (x * x**3 * 0.5 + x * 0.5) / (1 - x * 0.7))
