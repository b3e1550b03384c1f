"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolytics.scratch import shared_dir, stored  # noqa: F401  # the operators take them from here
from aerolytics.ship import BATCH_BYTES, BATCH_ROWS, ship, small_batches  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark alone (the path may be of any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list[Column]:
    """The columns as they are named, dots and backquotes included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in df.columns]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of ``df`` has."""
    taken, out = {n.lower() for n in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def schema_with(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` and further columns (name and type) at its end."""
    return StructType(df.schema.fields + StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items())).fields)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    small_batches(df.sparkSession)
    ship(df.sparkSession)
    if any(c in n for n in df.columns for c in ".`"):  # PySpark takes such names for paths here; in batches they count by position
        df = df.toDF(*[free_names(df, f"_column_{i}")[0] if "." in n or "`" in n else n for i, n in enumerate(df.columns)])
    return df.mapInArrow(run, schema)


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
