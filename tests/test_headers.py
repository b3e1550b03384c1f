import struct

import pytest
from pyspark.sql import functions as F

from aerolytics.sources import headers, logs


def lines(spark, *texts, log_id=1):
    return spark.createDataFrame([(log_id, i + 1, t) for i, t in enumerate(texts)], "log_id long, line_no int, line string")


def config(spark, *texts):
    return headers.system_config(headers.key_values(lines(spark, *texts))).head()


def test_block_ends_at_first_other_line(spark):
    logs_df = spark.createDataFrame([(1, "H a:1\nH b : 2 \0H none\nI data\nH c:3"), (2, "no header"), (3, "H x:y:z")], "log_id long, content string")
    rows = headers.key_values(headers.header_block(logs_df)).collect()
    assert sorted((r.log_id, r.line_no, r.key, r.value) for r in rows) == [(1, 1, "a", "1"), (1, 2, "b", "2"), (3, 1, "x", "y:z")]


def test_last_line_wins_across_keys(spark):
    assert config(spark, "H minthrottle:1070", "H motorOutput:48,2047").motor_output_low == 48
    r = config(spark, "H motorOutput:48,2047", "H minthrottle:1070", "H maxthrottle:oops", "H vbatcellvoltage:33,35", "H I interval:0", "H P interval:1/8", "H Data version:2")
    assert (r.motor_output_low, r.minthrottle, r.motor_output_high, r.maxthrottle) == (1070, 1070, 2047, 1850)
    assert (r.vbatmaxcellvoltage, r.i_interval, r.p_num, r.p_denom, r.data_version) == (43, 1, 1, 8, 2)


def test_firmware_and_scale_depend_on_order(spark):
    r = config(spark, "H Firmware type:Other", "H gyro_scale:0x3f800000", "H Firmware revision:Betaflight 4.5.1 (abc)")
    assert (r.firmware_type, r.fc_version, r.gyro_scale) == ("BETAFLIGHT", "4.5.1", 1.0)
    r = config(spark, "H Firmware type:Cleanflight", "H gyro.scale:0x3f800000")
    assert r.firmware_type == "CLEANFLIGHT" and r.gyro_scale == pytest.approx(3.141592653589793 / 180e6)
    assert config(spark, "H gyro_scale:zz").gyro_scale == pytest.approx(3.141592653589793 / 180e6)


@pytest.mark.parametrize("bits", [0x3F800000, 0xBF800001, 0x00000001, 0x7F7FFFFF, 0x80000000, 0x3089705F])
def test_float_from_bits(spark, bits):
    got = spark.range(1).select(headers.float_from_bits(F.lit(f"0x{bits:08x}")).alias("x")).head().x
    assert got == struct.unpack("<f", struct.pack("<I", bits))[0]


def test_field_definitions_pass_from_i_to_p(spark):
    found = headers.field_definitions(headers.key_values(lines(spark, "H Field I name:a,b,,c", "H Field I signed:1,x,1", "H Field I predictor:5,5", "H Field P predictor:1,2,3", "H Field P signed:0", "H Field S name:flags")))
    rows = {(r.frame_type, r.pos): (r.name, r.signed, r.width, r.predictor) for r in found.collect()}
    assert rows == {("I", 0): ("a", 1, 4, 5), ("I", 1): ("b", 0, 4, 5), ("I", 2): ("c", 1, 4, 0), ("P", 0): ("a", 0, 4, 1), ("P", 1): ("b", 0, 4, 2), ("P", 2): ("c", 1, 4, 3), ("S", 0): ("flags", 0, 4, 0)}


def test_gains(spark):
    pairs = headers.key_values(lines(spark, "H rollPID:45,80,40", "H yawPID:45,80", "H ff_weight:120"))
    r = headers.pidff(pairs).head()
    assert (r.roll_p, r.roll_i, r.roll_d, r.roll_ff, r.pitch_p, r.yaw_i, r.yaw_d, r.yaw_ff) == (45, 80, 40, 120, 0, 80, 0, 0)
    assert headers.pidff(pairs).select(headers.axis_text("roll").alias("x")).head().x == "P45 I80 D40 FF120"


def test_discovery(spark):
    files = spark.createDataFrame([("a", b"junk\xff##one##two"), ("b", b"none"), ("c", b"##"), ("d", b"")], "path string, content binary")
    rows = logs.discover_logs(files, "##").collect()
    assert sorted((r.path, r.log_index, r.start, r.end) for r in rows) == [("a", 0, 5, 10), ("a", 1, 10, 15), ("c", 0, 0, 2)]
    assert logs.pick_logs(logs.discover_logs(files, "##"), 1).count() == 1
