"""Binary log files of any size as a Spark data source, and files of rows written with a commit.

Reading: a file is cut into ranges of bytes.  A task looks for markers that start in its range - it reads on by the length
of a marker, so that one across an edge is found once - and cuts out each log's header by its offset; bodies are only
passed over, in windows of bounded size.

Writing: each attempt of a task writes files of its own in a folder aside.  When all tasks are done the driver moves the files of those
that count to their names and removes the folder, and if the write fails it removes it with all that is in it; a repeated,
failed or doubled attempt leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from aerolytics.ship import ship

#: Bytes of a range, of a window that is searched at once, and of a step in which a header is read.
SPLIT, WINDOW, STEP = 128 << 20, 4 << 20, 64 << 10
#: Ranges of a task, at most.
MOST = 128


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


# ---- reading ----


@dataclass
class Range:
    path: str
    size: int
    low: int
    high: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: a large range, or many small ones."""

    ranges: list[Range]


def together(ranges: list[Range]) -> list[Ranges]:
    """The ranges in order, as many to a task as stay within ``SPLIT`` bytes and ``MOST`` in number, so that small files are no tasks of their own."""
    out: list[Ranges] = []
    held = SPLIT
    for r in ranges:
        size = r.high - r.low
        if not out or held + size > SPLIT or len(out[-1].ranges) == MOST:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += size
    return out


def _read(held, low: int, high: int) -> bytes:
    held.seek(low)
    return held.read(max(high - low, 0))


def header_end(held, start: int, size: int, marker: bytes) -> int:
    """Where the header of the log at ``start`` ends: before the first line that isn't one of a header, or the next log."""
    data, at, beyond = b"", 0, max(len(marker), 2) - 1
    while True:
        before = len(data)
        data += _read(held, start + before, min(start + before + STEP, size))
        whole = start + len(data) >= size
        later = data.find(marker, max(before - beyond, len(marker)))
        if later >= 0:  # the next log, even in the middle of a line
            data, whole = data[:later], True
        known = len(data) if whole else len(data) - beyond
        while whole or at + 2 <= known:
            if not data.startswith(b"H ", at):
                return start + at
            ends = [e for e in (data.find(b"\n", at, known), data.find(b"\0", at, known)) if e >= 0]
            if not ends:
                if whole:
                    return start + len(data)
                break
            at = min(ends) + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.marker, self.split = options["marker"].encode("latin-1"), int(options.get("split_bytes", SPLIT))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        out = []
        for uri in self.paths:
            store, base = _store(uri)
            info = store.get_file_info(base)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
            for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
                out += [Range(f"{uri[: uri.index(':') + 1]}//{f.path}" if ":" in uri else f.path, f.size, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        return together(out) or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for own in part.ranges:
            yield from self._logs(own)

    def _logs(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, base = _store(part.path)
        size, marker = part.size, self.marker
        with store.open_input_file(base) as held:
            for low in range(part.low, part.high, WINDOW):
                high = min(low + WINDOW, part.high)
                data = _read(held, low, min(high + len(marker) - 1, size))
                at = data.find(marker)
                while at >= 0:
                    start = low + at
                    header = _read(held, start, header_end(held, start, size, marker))
                    yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([size], pa.int64()), pa.array([start], pa.int64()), pa.array([header], pa.binary())], ["path", "size", "start", "header"])
                    at = data.find(marker, at + len(marker))


def read_logs(spark: SparkSession, paths: str | list[str], marker: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """(path, log_index, start, end, header) of every log in files or folders; ``header`` is its header's text.

    Bytes before a file's first marker are no log; a log lasts to the next marker or the file's end.  A marker must not overlap
    itself.  Names that begin with a dot or an underscore are passed over.
    """
    from aerolytics.sources.logs import MARKER

    ship(spark)
    spark.dataSource.register(LogFiles)
    held = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("log_files").option("paths", json.dumps(held)).option("marker", (marker or MARKER).encode().decode("latin-1")).option("split_bytes", split_bytes).load()
    order = Window.partitionBy("path").orderBy("start")
    end = F.coalesce(F.lead("start").over(order), F.col("size"))
    return found.select("path", (F.row_number().over(order) - 1).alias("log_index"), "start", end.alias("end"), F.decode("header", "ISO-8859-1").alias("header"))


def log_name(path: Column, log_index: Column) -> Column:
    """What a log of a file is known by: its path and number."""
    return F.concat(path, F.lit("#"), log_index.cast("string"))


def read_header_rows(spark: SparkSession, paths: str | list[str], marker: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """(log_id, path, log_index, line_no, key, value): the header rows of every log in files or folders."""
    from aerolytics.sources.headers import header_block, key_values

    logs = read_logs(spark, paths, marker, split_bytes).withColumn("log_id", F.struct("path", "log_index"))
    rows = key_values(header_block(logs.select("log_id", F.col("header").alias("content"))))
    return rows.select(log_name(F.col("log_id.path"), F.col("log_id.log_index")).alias("log_id"), "log_id.path", "log_id.log_index", "line_no", "key", "value")


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.aside = options["path"], options["aside"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.folder)
        current, sink, files = None, None, {}
        try:
            for batch in iterator:
                for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if file != current:
                        if sink is not None:
                            sink.close()
                        if file in files:
                            raise ValueError(f"the rows of {file} don't stand together")
                        current, files[file] = file, f"{base}/{self.aside}/{uuid.uuid4().hex}"
                        store.create_dir(f"{base}/{self.aside}", recursive=True)
                        sink = store.open_output_stream(files[file])
                    sink.write(content or b"")
        finally:
            if sink is not None:
                sink.close()
        return Written(files)

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = _store(self.folder)
        if store.get_file_info(f"{base}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.aside}")

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.folder)
        files = [f for m in messages if m for f in m.files.items()]
        if len({file for file, _ in files}) < len(files):
            raise ValueError("the rows of a file are in several tasks")
        for file, path in files:
            if store.get_file_info(f"{base}/{file}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/{file}")
            store.move(path, f"{base}/{file}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


def write_files(rows: DataFrame, folder: str, together: bool = False) -> None:
    """Write (file, place, content binary) as files of a folder: a file is the contents of its rows in the order of ``place``.

    A file's rows pass through one task in sorted batches.  Files of these names are replaced, others stay.  ``together`` tells that
    each file's rows stand in one task and in order already, so that they need not be shuffled.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(LogFiles)
    ordered = rows if together else rows.repartition("file").sortWithinPartitions("file", "place")
    ordered.select("file", "content").write.format("log_files").option("path", folder).option("aside", f"_aside-{uuid.uuid4().hex}").mode("append").save()


class LogFiles(DataSource):
    """``log_files``: ``read_logs`` reads and ``write_files`` writes it."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return "path string, size long, start long, header binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))
