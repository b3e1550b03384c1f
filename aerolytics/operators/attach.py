"""Join a value per log back to its frames without shuffling the frames by log.

The side (one row per key: a maximum, a configuration, a range) is computed once and stored.  Up
to ``BROADCAST_BYTES`` it is broadcast and the frames stay where they are.  A larger one is dealt to
the chunks of each log and joined by (keys, chunk), so that a log with a third of all rows still
spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from aerolytics.operators.ordered import CHUNK
from aerolytics.scratch import stored

#: Estimated bytes of a side that may be broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(schema: StructType) -> int:
    """A generous estimate of a row's size in memory: texts count 64 bytes, nested values 256."""
    size = {StringType: 64, ArrayType: 256, MapType: 256, StructType: 256}
    return 32 + sum(size.get(type(f.dataType), 16) for f in schema.fields)


def small(side: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """The side, stored, and whether its rows fit the limit of a broadcast."""
    kept = stored(side)
    return kept, kept.count() * row_bytes(kept.schema) <= (BROADCAST_BYTES if limit is None else limit)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column | list[Column], how: str = "inner") -> DataFrame:
    """A join by sorted shuffles, which Spark never makes a broadcast of: it takes a side for as large as the files below it, whatever an explode made of their rows."""
    return left.join(right.hint("merge"), on, how)


def attach(frames: DataFrame, side: DataFrame, keys: list[str] | None = None, order: str = "frame_seq", how: str = "inner", limit: int | None = None, rows: int = CHUNK) -> DataFrame:
    """The frames with the side's columns; ``how`` is inner, or left to keep frames without a side row.

    ``order`` is the row's place in its log; it is only used where the side is too large to be broadcast.
    """
    keys = keys or ["log_id"]
    kept, fits = small(side, limit)
    if fits:
        return frames.join(F.broadcast(kept), keys, how)
    part: Column = F.floor(F.coalesce(F.col(order), F.lit(0)) / rows).cast("bigint")
    cut = frames.withColumn("_part", part)
    parts = cut.groupBy(*keys).agg(F.min("_part").alias("_low"), F.max("_part").alias("_high"))
    dealt = merge_join(kept, parts, keys).withColumn("_part", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    return merge_join(cut, dealt, [*keys, "_part"], how).drop("_part")
