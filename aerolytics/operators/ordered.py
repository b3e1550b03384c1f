"""Ordered operators on logs of any length: a log is cut into chunks of consecutive rows.

Each chunk is a window partition of its own, so one log that holds a third of all rows spreads over
many tasks.  What a chunk needs from those before it (a last row, a total) is one row per chunk,
computed by a small window over chunks and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a chunk.
CHUNK = 100_000


def _chunk(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / rows).cast("bigint")


def _joined(df: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    from aerolytics.operators.attach import merge_join, small

    names = [*keys, "_chunk"]
    kept, fits = small(side)  # a row per chunk: broadcast if it may be, so that the rows stay where they are
    other = kept.select(*[F.col(n).alias(f"_of_{n}") for n in names], *[c for c in side.columns if c not in names])
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]
    return (df.join(F.broadcast(other), same, "left") if fits else merge_join(df, other, same, "left")).drop(*[f"_of_{n}" for n in names])


def lagged(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], rows: int = CHUNK) -> DataFrame:
    """Adds, for each new name, the value that a column has in the row before; null in a log's first row."""
    cut = df.withColumn("_chunk", _chunk(order, rows))
    last = cut.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), order).alias("_last"))
    prior = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_prior"))
    own = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = _joined(cut, keys, prior).withColumn("_first", F.row_number().over(own) == 1)
    found = {n: F.when(F.col("_first"), F.col(f"_prior.{n}")).otherwise(F.lag(c).over(own)) for n, c in columns.items()}
    return out.withColumns(found).drop("_chunk", "_prior", "_first")


def running_sum(df: DataFrame, keys: list[str], order: str, column: str, name: str, rows: int = CHUNK) -> DataFrame:
    """Adds the sum of a column over a log's rows up to this one."""
    cut = df.withColumn("_chunk", _chunk(order, rows))
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum(column).alias("_total"))
    before = totals.select(*keys, "_chunk", F.sum("_total").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(cut, keys, before).withColumn(name, F.sum(column).over(own) + F.coalesce("_before", F.lit(0))).drop("_chunk", "_before")


def last_known(df: DataFrame, keys: list[str], order: str, value: Column, name: str, rows: int = CHUNK) -> DataFrame:
    """Adds the latest value that isn't null, this row's own included."""
    cut = df.withColumns({"_chunk": _chunk(order, rows), "_value": value})
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    own = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_value", ignorenulls=True).over(own), F.col("_before"))
    return _joined(cut, keys, before).withColumn(name, found).drop("_chunk", "_value", "_before")


def with_guests(df: DataFrame, order: str, before: int, after: int, rows: int = CHUNK) -> DataFrame:
    """Adds ``_chunk`` and ``_guest``: rows within ``before`` or ``after`` places of another chunk stand in it, too, as guests.

    A window over (keys, _chunk) then sees all rows that its frame can reach; guests are dropped after it.
    """
    own, ahead, behind = _chunk(order, rows), F.floor((F.col(order) + before) / rows).cast("bigint"), F.floor((F.col(order) - after) / rows).cast("bigint")
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(F.greatest(behind, F.lit(0)), ahead)))
    return spread.withColumn("_guest", F.col("_chunk") != F.col("_own")).drop("_own")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int = CHUNK) -> DataFrame:
    """Adds each row's place in its group, from 0, by the order; the first of ``order`` is a number that cuts the group into chunks."""
    cut = df.withColumn("_chunk", _chunk(order[0], rows))
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    before = sizes.select(*keys, "_chunk", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return _joined(cut, keys, before).withColumn(name, F.row_number().over(own).cast("bigint") - 1 + F.coalesce("_before", F.lit(0))).drop("_chunk", "_before")
