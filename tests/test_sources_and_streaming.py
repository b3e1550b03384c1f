import numpy as np

from aerolytics.operators import frames as fr
from aerolytics.sources import logs
from aerolytics.streaming.validity import validate_stream


def test_decoded_files_of_several_schemas(spark, tmp_path):
    (tmp_path / "a.01.csv").write_text("loopIteration,time,gyroADC[0]\n8,20,3\n0,10,1\n4,15,2\nx,1,1\n5,6\n")
    (tmp_path / "a.02.csv").write_text('"loopIteration","time","gyroData[0]"\r\n0,1,7\r\n')
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    (tmp_path / "half.csv").write_text("loopIteration,y\n1,2\n")
    (tmp_path / "empty.01.csv").write_text("")
    frames, wrong = logs.read_decoded_csv(spark, str(tmp_path))
    from aerolytics.operators.stats import canonical_frames

    rows = canonical_frames(frames).orderBy("log_index", "frame_seq").collect()
    assert [(r.log_index, r.frame_seq, r.gyro_roll) for r in rows] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 7)]
    assert sorted((r.path.rpartition("/")[2], r.line) for r in wrong.collect()) == sorted([("a.01.csv", "x,1,1"), ("a.01.csv", "5,6"), ("bad.csv", None), ("half.csv", None)], key=str)
    none, wrong = logs.read_decoded_csv(spark, [str(tmp_path / "bad.csv")])
    assert none.count() == 0 and wrong.count() == 1


def test_decoded_files_are_written_by_name(spark, tmp_path):
    frames = spark.createDataFrame([(1, i, i, i * 10, i * i, None) for i in range(30)] + [(2, 0, 0, 5, None, 9)], "log_id long, frame_seq long, loopIteration long, time long, `gyroADC[0]` long, `gyroData[0]` long").repartition(4)
    named = spark.createDataFrame([(1, "f", 0), (2, "f", 11)], "log_id long, stem string, log_index int")
    for _ in range(2):  # a second run replaces the files
        made = sorted((r.file, r.rows) for r in logs.write_decoded_csv(frames, named, str(tmp_path)).collect())
    assert made == [("f.01.csv", 30), ("f.12.csv", 1)] and sorted(x.name for x in tmp_path.iterdir()) == ["f.01.csv", "f.12.csv"]
    assert (tmp_path / "f.01.csv").read_text().splitlines()[:3] == ["loopIteration,time,gyroADC[0]", "0,0,0", "1,10,1"]
    assert (tmp_path / "f.12.csv").read_text() == "loopIteration,time,gyroData[0]\n0,5,9\n"
    back, wrong = logs.read_decoded_csv(spark, str(tmp_path / "*.csv"))
    assert back.count() == 31 and wrong.count() == 0


def test_binary_files_and_their_logs(spark, tmp_path):
    (tmp_path / "a.bbl").write_bytes(b"junk\xff" + logs.MARKER.encode() + b"H a:1\nI\x00\xfe" + logs.MARKER.encode())
    (tmp_path / "b.bbl").write_bytes(b"none")
    files = logs.read_log_files(spark, str(tmp_path))
    size = len(logs.MARKER)
    assert sorted((r.log_index, r.start, r.end) for r in logs.discover_logs(files).collect()) == [(0, 5, 14 + size), (1, 14 + size, 14 + 2 * size)]
    assert {r.path.rpartition("/")[2]: r.length for r in files.collect()} == {"a.bbl": 14 + 2 * size, "b.bbl": 4}


def test_quarantine_keeps_unknowns_out(spark):
    from pyspark.sql import functions as F

    good, bad = logs.quarantine(spark.createDataFrame([(1,), (2,), (None,)], "x int"), F.col("x") > 1, "large")
    assert [r.x for r in good.collect()] == [1] and sorted((str(r.x), r.reason) for r in bad.collect()) == [("2", "large"), ("None", "large")]


def test_report_counts_the_logs_of_a_file(spark):
    from aerolytics.sources import headers

    lines = spark.createDataFrame([(i, 1, "H Data version:2") for i in (1, 2, 3)], "log_id long, line_no int, line string")
    pairs = headers.key_values(lines)
    files = spark.createDataFrame([(1, "/x/a.bbl", 0), (2, "/x/a.bbl", 1)], "log_id long, path string, log_index int")
    rows = sorted((r.log_id, r.file, r.n_logs, r.data_version) for r in logs.log_report(headers.system_config(pairs), headers.field_definitions(pairs), headers.raw_headers(pairs), files).collect())
    assert rows == [(1, "a.bbl", 2, 2), (2, "a.bbl", 2, 2), (3, None, None, 2)]


def test_scratch_needs_a_shared_folder(spark):
    from aerolytics import scratch

    path = scratch.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in path and scratch.shared_dir(spark) != path

    class Cluster:
        class conf:
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getCheckpointDir = staticmethod(lambda: None)

    import pytest

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_csv_round_trip_of_an_empty_and_a_full_log(spark, tmp_path):
    df = spark.createDataFrame([(1, i, i * i) for i in range(50)], "log_id long, frame_seq long, x long").repartition(4)
    logs.write_log_csv(df, str(tmp_path / "out"))
    back = logs.read_log_csv(spark, str(tmp_path / "out"), "frame_seq long, x long, log_id long")
    assert sorted(map(tuple, back.select("log_id", "frame_seq", "x").collect())) == sorted(map(tuple, df.collect()))


def test_csv_files_are_as_many_as_rows_need_not_as_logs(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, i // 40, f'a,"{i}"' if i % 3 else None) for i in range(400)], "log_id long, frame_seq long, x string").repartition(4)
    for folders, most in ((False, 8), (True, 40)):
        out = tmp_path / f"out_{folders}"
        logs.write_log_csv(df, str(out), folders)
        assert 0 < len(list(out.rglob("*.csv"))) <= most and len(list(out.glob("log_id=*"))) == 40 * folders
        for schema in ("frame_seq long, x string, log_id long", None):
            back = logs.read_log_csv(spark, str(out), schema)
            assert sorted(map(str, back.select("log_id", "frame_seq", "x").collect())) == sorted(map(str, df.collect()))


def test_live_validity_equals_batch_and_names_late_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for log in (1, 2):
        i, t = 0, 4_294_967_296 - 40_000 * log
        for s in range(90):
            i, t = i + int(rng.integers(0, 5)), t + 1000
            jump = 30_000_000 if log == 2 and s == 50 else 0
            t += jump
            rows.append((log, s, "I" if s % 10 == 0 else "P", i, t % (1 << 32)))
    schema = "log_id long, stream_seq long, kind string, iteration long, time32 long"
    for k in range(3):  # ordered micro-batches, one file each
        part = [r for r in rows if k * 30 <= r[1] < k * 30 + 30]
        late = [(1, 5, "P", 0, 0)] if k == 2 else []
        spark.createDataFrame(part + late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = validate_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.log_id, r.stream_seq) for r in found if r.verdict == "late"] == [(1, 5)]
    batch = fr.validate_logs(spark.createDataFrame(rows, schema))
    expected = {(r.log_id, r.stream_seq): "valid" if r.valid else "invalid" for r in batch.collect()}
    assert {(r.log_id, r.stream_seq): r.verdict for r in found if r.verdict != "late"} == expected
    times = {(r.log_id, r.stream_seq): r.time for r in batch.collect()}
    assert {(r.log_id, r.stream_seq): r.time for r in found if r.verdict != "late"} == times
    assert max(times.values()) > 1 << 32
