"""Log files in ranges of bytes, and the writer's commit."""

import os

import numpy as np
import pyarrow as pa
import pytest

from aerolytics.sources import log_files
from aerolytics.sources.logs import MARKER

MARK = MARKER.encode()


def plain_logs(data):
    """(start, end, header lines) of each log, byte by byte."""
    starts, at = [], data.find(MARK)
    while at >= 0:
        starts.append(at)
        at = data.find(MARK, at + len(MARK))
    out = []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        lines, at = [], a
        while at < b and data[at : at + 2] == b"H ":
            ends = [e for e in (data.find(b"\n", at, b), data.find(b"\0", at, b)) if e >= 0]
            end = min(ends) if ends else b
            lines.append(data[at:end].decode("latin-1"))
            at = end + 1
        out.append((a, b, lines))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    dice = np.random.default_rng(4)
    line = lambda: b"H key%d:%s" % (dice.integers(100), b"v" * int(dice.integers(0, 90)))
    bodies = [b"I\x00\x01H \xff\n", b"", b"\n\n", b"H", b"P" * 5_000, b"Hx no header\n", MARK[:30], b"\x00H after:1\n"]
    files = {}
    for k in range(6):
        logs = [MARK + b"".join(line() + (b"\n" if dice.random() < 0.8 else b"\0") for _ in range(int(dice.integers(0, 60)))) + bodies[int(dice.integers(len(bodies)))] for _ in range(int(dice.integers(1, 5)))]
        files[f"f{k}.bbl"] = (b"junk\n" if k % 2 else b"") + b"".join(logs)
    files |= {"none.bbl": b"no log at all", "empty.bbl": b"", "tail.bbl": MARK + b"H last:1", "_hidden.bbl": MARK, "sub/deep.bbl": MARK + b"H a:b\n"}
    for name, data in files.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(data)
    return base, {n: d for n, d in files.items() if not n.startswith("_")}


@pytest.mark.parametrize("split, window, step", [(1 << 20, 4 << 20, 64 << 10), (61, 4 << 20, 7), (997, 13, 50)])
def test_logs_across_edges_equal_a_plain_search(folder, split, window, step, monkeypatch):
    monkeypatch.setattr(log_files, "WINDOW", window)
    monkeypatch.setattr(log_files, "STEP", step)
    base, files = folder
    import json

    reader = log_files._Reader({"paths": json.dumps([str(base)]), "marker": MARKER, "split_bytes": split})
    found = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            for r in batch.to_pylist():
                found.setdefault(os.path.relpath(r["path"], base), []).append((r["start"], r["header"]))
    for name, data in files.items():
        own = plain_logs(data)
        assert [s for s, _ in sorted(found.get(name, []))] == [s for s, _, _ in own], name
        for (start, header), (_, _, lines) in zip(sorted(found.get(name, [])), own, strict=True):
            cut = header.decode("latin-1").replace("\0", "\n").split("\n")
            assert (cut[:-1] if cut[-1] == "" else cut) == lines, (name, start)


def test_rows_of_files(spark, folder):
    base, files = folder
    logs = log_files.read_logs(spark, [f"{base}/f0.bbl", f"file://{base}/sub"], split_bytes=100).collect()
    expected = [(i, a, b) for n in ("f0.bbl", "sub/deep.bbl") for i, (a, b, _) in enumerate(plain_logs(files[n]))]
    assert sorted((r.log_index, r.start, r.end) for r in logs) == sorted(expected)
    rows = log_files.read_header_rows(spark, str(base), split_bytes=500).collect()
    wanted = [(os.path.basename(n), i, at, *(x.strip() for x in line[2:].split(":", 1))) for n, d in files.items() for i, (_, _, lines) in enumerate(plain_logs(d)) for at, line in enumerate(lines, 1) if ":" in line[2:]]
    assert sorted((os.path.basename(r.path), r.log_index, r.line_no, r.key, r.value) for r in rows) == sorted(wanted)


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"file": f, "content": c} for f, c in rows])


def test_failed_and_doubled_attempts_leave_nothing(tmp_path):
    options = {"path": str(tmp_path), "aside": "_aside-1"}
    (tmp_path / "a.csv").write_bytes(b"old")
    (tmp_path / "other.csv").write_bytes(b"kept")
    task, twin = (log_files._Writer(options).write(iter([batch(("a.csv", b"x"), ("a.csv", b"y")), batch(("a.csv", b"z"), ("b.csv", None))])) for _ in range(2))
    with pytest.raises(ValueError, match="together"):
        log_files._Writer(options).write(iter([batch(("a.csv", b"x"), ("b.csv", b"y"), ("a.csv", b"z"))]))
    assert (tmp_path / "a.csv").read_bytes() == b"old"  # nothing counts before the commit
    log_files._Writer(options).commit([task, None])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.csv": b"xyz", "b.csv": b"", "other.csv": b"kept"}
    lost = log_files._Writer({**options, "aside": "_aside-2"})
    lost.abort([lost.write(iter([batch(("c.csv", b"1"))])), None])
    assert {p.name for p in tmp_path.iterdir()} == {"a.csv", "b.csv", "other.csv"} and twin.files.keys() == task.files.keys()


def test_a_write_that_fails_in_a_task_leaves_the_folder_as_it_was(spark, tmp_path):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    (tmp_path / "f0").write_bytes(b"old")
    rows = spark.range(100).select(F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file"), F.col("id").alias("place"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(PySparkException):
        log_files.write_files(rows, str(tmp_path))
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("f0", b"old")]
    log_files.write_files(rows.where("id < 99"), str(tmp_path))
    assert {p.name: len(p.read_bytes()) for p in tmp_path.iterdir()} == {"f0": 20, "f1": 20, "f2": 20, "f3": 20, "f4": 19}


def test_a_task_reads_many_small_ranges(tmp_path):
    import json

    for i in range(40):
        (tmp_path / f"f{i:02d}.bbl").write_bytes(b"x" * 1_000)
    parts = log_files._Reader({"paths": json.dumps([str(tmp_path)]), "marker": MARKER, "split_bytes": 100}).partitions()
    assert [len(p.ranges) for p in parts] == [128, 128, 128, 16]
    assert len({(r.path, r.low) for p in parts for r in p.ranges}) == 400
