"""Unit conversions as column expressions; a log's configuration comes along as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEGREES = 180.0 / math.pi


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, for a divisor above 0 (``div`` would truncate)."""
    return F.call_function("div", a - F.pmod(a, b), b)


def _int(x: int) -> Column:
    return F.lit(x).cast("bigint")


def vbat_to_millivolts(adc: Column, vbatscale: Column) -> Column:
    """Battery voltage from a 12-bit reading against 3.3 V."""
    return floor_div(adc * _int(330) * vbatscale, _int(4095))


def vbat_to_volts(adc: Column, vbatscale: Column) -> Column:
    return vbat_to_millivolts(adc, vbatscale) / 1000.0


def amperage_to_milliamps(adc: Column, offset: Column, scale: Column) -> Column:
    """Current; may be negative, so that both divisions round down.  A scale of 0 gives null."""
    millivolts = floor_div(adc * _int(3300), _int(4095)) - offset
    positive = F.when(scale > 0, floor_div(millivolts * 10000, F.when(scale > 0, scale)))
    return F.when(scale < 0, floor_div(-millivolts * 10000, F.when(scale < 0, -scale))).otherwise(positive)


def amperage_to_amps(adc: Column, offset: Column, scale: Column) -> Column:
    return amperage_to_milliamps(adc, offset, scale) / 1000.0


def cell_count(vbatref: Column, vbatscale: Column, max_cell: Column) -> Column:
    """The smallest number of cells, up to 7, whose full voltage exceeds the reference; else 8."""
    tenths = floor_div(vbat_to_millivolts(vbatref, vbatscale), _int(100))
    out = F.lit(8)
    for cells in range(7, 0, -1):
        out = F.when(tenths < cells * max_cell, cells).otherwise(out)
    return out


def gyro_to_radians(raw: Column, gyro_scale: Column) -> Column:
    return gyro_scale * 1_000_000 * raw


def gyro_to_degrees(raw: Column, gyro_scale: Column) -> Column:
    return gyro_to_radians(raw, gyro_scale) * DEGREES


def acceleration_to_g(raw: Column, acc_1g: Column) -> Column:
    return F.when(acc_1g == 0, 0.0).otherwise(raw / F.when(acc_1g != 0, acc_1g))


def motor_to_percent(value: Column, low: Column, high: Column) -> Column:
    """Percent of the output range; an empty range gives 0."""
    span = high - low
    return F.when(span == 0, 0.0).otherwise((value - low) / F.when(span != 0, span) * 100.0)


def micros_to_seconds(micros: Column) -> Column:
    return micros / 1_000_000.0


def phase_shift_degrees(delay_ms: Column, freq_hz: Column, negative_is_zero: bool = True) -> Column:
    """Delay as degrees of a period; 0 Hz gives 0, and so does a negative frequency unless told otherwise."""
    none = freq_hz <= 0 if negative_is_zero else freq_hz == 0
    return F.when(none, 0.0).otherwise(delay_ms / (1000.0 / F.when(~none, freq_hz)) * 360.0)


def rate_curve(configs: DataFrame, max_rc: int = 500, rate_constant: float = 200.0) -> DataFrame:
    """Degrees a second at each stick position 0..max_rc for configs with rc_rate, rc_expo, super_rate.

    The super rate works on the stick before expo; rates above 2 grow by 14.54 for each unit beyond.
    """
    sticks = configs.withColumn("rc", F.explode(F.sequence(F.lit(0), F.lit(max_rc))))
    stick = F.col("rc") / 500.0
    bent = F.when(F.col("rc_expo") > 0, stick * F.pow(stick, F.lit(3.0)) * F.col("rc_expo") + stick * (1 - F.col("rc_expo"))).otherwise(stick)
    rate = F.when(F.col("rc_rate") > 2.0, F.col("rc_rate") + (F.col("rc_rate") - 2.0) * 14.54).otherwise(F.col("rc_rate"))
    plain = rate_constant * rate * bent
    factor = 1.0 / F.greatest(1.0 - stick * F.col("super_rate"), F.lit(0.01))
    return sticks.withColumn("deg_s", F.when(F.col("super_rate") > 0, plain * factor).otherwise(plain))
