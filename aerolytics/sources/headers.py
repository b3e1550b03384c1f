"""Header blocks of logs: key/value rows, and the typed tables derived from them.

Input lines carry ``line_no``: what a header means may depend on the order of its lines.
A number that can't be read falls back to the default.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

AXES = ("roll", "pitch", "yaw")
# Defaults of the system configuration.
DEFAULTS = {
    "minthrottle": 1150, "maxthrottle": 1850, "motor_output_low": 1150, "motor_output_high": 1850, "rc_rate": 90, "yaw_rate": 0, "acc_1g": 1, "vbatscale": 110,
    "vbatmaxcellvoltage": 43, "vbatmincellvoltage": 33, "vbatwarningcellvoltage": 35, "current_meter_offset": 0, "current_meter_scale": 400, "vbatref": 4095,
    "data_version": 0, "i_interval": 32, "p_num": 1, "p_denom": 1,
}
# The fields that a key of the header sets, by the place in its list of values, and how many values it needs.
KEY_FIELDS = {
    "minthrottle": (1, ((0, "minthrottle"), (0, "motor_output_low"))),
    "maxthrottle": (1, ((0, "maxthrottle"), (0, "motor_output_high"))),
    "motorOutput": (2, ((0, "motor_output_low"), (1, "motor_output_high"))),
    "rcRate": (1, ((0, "rc_rate"),)),
    "acc_1G": (1, ((0, "acc_1g"),)),
    "vbatscale": (1, ((0, "vbatscale"),)),
    "vbatref": (1, ((0, "vbatref"),)),
    "vbatcellvoltage": (3, ((0, "vbatmincellvoltage"), (1, "vbatwarningcellvoltage"), (2, "vbatmaxcellvoltage"))),
    "currentMeter": (2, ((0, "current_meter_offset"), (1, "current_meter_scale"))),
    "Data version": (1, ((0, "data_version"),)),
    "I interval": (1, ((0, "i_interval"),)),
    "P interval": (2, ((0, "p_num"), (1, "p_denom"))),
}


def header_block(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, line) of the header block at the start of ``content``: lines up to the first without ``H ``.

    Lines end at a line feed or a NUL.
    """
    lines = logs.select("log_id", F.posexplode(F.split("content", "[\n\u0000]")).alias("at", "line"))
    head = F.min(F.when(~F.col("line").startswith("H "), F.col("at"))).over(Window.partitionBy("log_id"))
    return lines.withColumn("stop", head).where("stop is null or at < stop").select("log_id", (F.col("at") + 1).alias("line_no"), "line")


def key_values(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, key, value): each header line split at its first colon, both sides trimmed; others go."""
    text = lines.where(F.col("line").startswith("H ")).withColumn("text", F.expr("substring(line, 3)"))
    colon = F.instr("text", ":")
    return text.where(colon > 0).select("log_id", "line_no", F.trim(F.expr("substring(text, 1, instr(text, ':') - 1)")).alias("key"), F.trim(F.expr("substring(text, instr(text, ':') + 1)")).alias("value"))


def raw_headers(pairs: DataFrame) -> DataFrame:
    """(log_id, key, value): the last value of each key."""
    return pairs.groupBy("log_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def _items(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def _ints(value: Column) -> Column:
    """The integers of a list; what is no integer is 0, what is empty is skipped."""
    return F.transform(_items(value), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def field_definitions(pairs: DataFrame) -> DataFrame:
    """(log_id, frame_type, pos, name, signed, width, predictor, encoding) from the ``Field`` lines.

    P frames take names and signs from I frames; of several lines the last that covers a place counts.
    """
    fields = pairs.where(F.col("key").startswith("Field ")).select(
        "log_id", "line_no", F.expr("substring(key, 7, 1)").alias("frame_type"), F.regexp_extract("key", r" (name|signed|predictor|encoding|width)$", 1).alias("what"), "value"
    )
    own = fields.where("what <> ''")
    passed = own.where("frame_type = 'I' and what in ('name', 'signed')").withColumn("frame_type", F.lit("P"))
    lines = own.unionByName(passed)
    names = lines.where("what = 'name'").groupBy("log_id", "frame_type").agg(F.max_by("value", "line_no").alias("value"))
    places = names.select("log_id", "frame_type", F.posexplode(_items(F.col("value"))).alias("pos", "name"))
    values = lines.where("what <> 'name'").select("log_id", "frame_type", "what", "line_no", F.posexplode(_ints(F.col("value"))).alias("pos", "v"))
    last = values.groupBy("log_id", "frame_type", "pos").pivot("what", ["signed", "width", "predictor", "encoding"]).agg(F.max_by("v", "line_no"))
    joined = places.join(last, ["log_id", "frame_type", "pos"], "left")
    return joined.select("log_id", "frame_type", "pos", "name", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("signed", 0), ("width", 4), ("predictor", 0), ("encoding", 0))])


def firmware(pairs: DataFrame) -> DataFrame:
    """(log_id, firmware_type, fc_version, firmware_revision) for logs with a firmware line; the last line counts."""
    says = pairs.where("key in ('Firmware type', 'Firmware revision')")
    return says.groupBy("log_id").agg(*_firmware_parts())


def _firmware_parts() -> list[Column]:
    kind = _firmware_type()
    version = F.when((F.col("key") == "Firmware revision") & F.col("value").startswith("Betaflight "), F.get(F.split("value", " "), F.lit(1)))
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("line_no")))
    return [last(kind).alias("firmware_type"), last(version).alias("fc_version"), last(F.when(F.col("key") == "Firmware revision", F.col("value"))).alias("firmware_revision")]


def _firmware_type() -> Column:
    return F.when((F.col("key") == "Firmware type") & (F.col("value") == "Cleanflight"), "CLEANFLIGHT").when(F.col("key") == "Firmware type", "BASEFLIGHT").when(
        (F.col("key") == "Firmware revision") & F.col("value").startswith("Betaflight "), "BETAFLIGHT"
    )


def float_from_bits(text: Column) -> Column:
    """The 32-bit float whose bits a hexadecimal text gives; null if it gives none."""
    digits = F.regexp_extract(F.lower(text), "^(?:0x)?([0-9a-f]{1,8})$", 1)
    bits = F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF))
    normal = (1 + mantissa / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127)
    special = F.when(mantissa == 0, float("inf")).otherwise(float("nan"))
    return sign * F.when(exponent == 255, special).when(exponent == 0, mantissa / float(1 << 23) * 2.0**-126).otherwise(normal)


def _scale_parts() -> list[Column]:
    """The last line with a scale and its number, and all lines that tell the firmware's type; few for each log."""
    is_scale, kind = F.col("key").isin("gyro.scale", "gyro_scale"), _firmware_type()
    told = F.when(kind.isNotNull(), F.struct("line_no", kind.alias("type")))
    return [F.max_by("value", F.when(is_scale, F.col("line_no"))).alias("_scale"), F.max(F.when(is_scale, F.col("line_no"))).alias("_scale_line"), F.array_sort(F.collect_list(told)).alias("_told")]


def _scale() -> Column:
    """The scale by the parts above, in radians a microsecond unless the firmware known by its line is BASEFLIGHT; null without one."""
    known = F.filter("_told", lambda x: x["line_no"] < F.col("_scale_line"))
    kind = F.get(known, F.size(known) - 1)["type"]
    value = F.coalesce(float_from_bits(F.col("_scale")), F.lit(1.0))
    return F.when(F.col("_scale_line").isNotNull(), F.when(kind == "BASEFLIGHT", value).otherwise(value * (math.pi / 180.0) * 0.000001))


def gyro_scales(pairs: DataFrame) -> DataFrame:
    """(log_id, gyro_scale): the last line counts, in radians a microsecond unless the firmware known by then is BASEFLIGHT."""
    return pairs.groupBy("log_id").agg(*_scale_parts()).select("log_id", _scale().alias("gyro_scale")).where("gyro_scale is not null")


def _field_values() -> dict[str, tuple[Column, Column]]:
    """For each field, the value that a line gives it and whether the line sets it at all."""
    value = F.when(F.col("key") == "P interval", F.when(F.col("value").contains("/"), F.regexp_replace("value", "/", ","))).otherwise(F.col("value"))
    items = _items(value)
    listed = F.col("key").isin("motorOutput", "vbatcellvoltage", "currentMeter")
    out: dict[str, tuple[Column, Column]] = {}
    for key, (need, fields) in KEY_FIELDS.items():
        for place, field in fields:
            number = F.get(items, F.lit(place)).try_cast("int")
            number = F.when(listed, F.coalesce(number, F.lit(0))).otherwise(number)
            sets = (F.col("key") == key) & (F.size(items) >= need) & number.isNotNull()
            had = out.get(field)
            out[field] = (number, sets) if had is None else (F.when(sets, number).otherwise(had[0]), had[1] | sets)
    return out


def system_config(pairs: DataFrame) -> DataFrame:
    """One typed row per log: all defaults, overruled by the last line that sets a field; one aggregate over the lines."""
    values = _field_values()
    last = [F.max_by(v, F.when(sets, F.col("line_no"))).alias(field) for field, (v, sets) in values.items()]
    started = F.when(F.col("key").startswith("Log start datetime"), F.try_to_timestamp("value"))
    found = pairs.groupBy("log_id").agg(*last, *_firmware_parts(), *_scale_parts(), F.max_by(started, F.when(started.isNotNull(), F.col("line_no"))).alias("log_start"))
    value = lambda c: F.coalesce(c, F.lit(DEFAULTS[c])) if c in values else F.lit(DEFAULTS[c])
    typed = [(F.greatest(value(c), F.lit(1)) if c == "i_interval" else value(c)).cast("int").alias(c) for c in DEFAULTS]
    return found.select(
        "log_id", *typed, F.coalesce(_scale(), F.lit(1.0)).alias("gyro_scale"), F.coalesce("firmware_type", F.lit("UNKNOWN")).alias("firmware_type"),
        F.coalesce("fc_version", F.lit("")).alias("fc_version"), F.coalesce("firmware_revision", F.lit("")).alias("firmware_revision"), "log_start",
    )


def pidff(pairs: DataFrame) -> DataFrame:
    """(log_id, roll_p .. yaw_ff): gains by axis; what a list lacks is 0."""
    values = {f"{a}PID": [f"{a}_{g}" for g in "pid"] for a in AXES} | {"ff_weight": [f"{a}_ff" for a in AXES]}
    logs = pairs.groupBy("log_id").agg(*[F.expr(f"max_by(value, line_no) filter (where key = '{k}')").alias(k) for k in values])
    at = lambda k, i: F.coalesce(F.get(_items(F.col(k)), F.lit(i)).try_cast("int"), F.lit(0))
    found = {name: at(k, i) for k, names in values.items() for i, name in enumerate(names)}
    return logs.select("log_id", *[found[f"{a}_{g}"].alias(f"{a}_{g}") for a in AXES for g in ("p", "i", "d", "ff")])


def axis_text(axis: str) -> Column:
    """Gains of an axis as text, like ``P45 I80 D30 FF120``."""
    return F.format_string("P%d I%d D%d FF%d", *[F.col(f"{axis}_{g}") for g in ("p", "i", "d", "ff")])


def pidff_table(catalog: DataFrame, gains: DataFrame) -> DataFrame:
    """Comparison table: label, the gains of each axis as text, file and the selected duration."""
    joined = catalog.join(gains, "log_id")
    duration = F.format_string("%.1fs", F.bround(F.col("time_end_s") - F.col("time_start_s"), 1))  # halves to the even tenth
    return joined.select("log_id", "label", *[axis_text(a).alias(f"{a}_gains") for a in AXES], "file", duration.alias("duration"))
