"""One row of each group: decisions by row keys, taken without moving the texts of rows that simply stay.

A row is known by its ``doc_id`` and a hash of its text, so rows that repeat an id with unlike texts, and rows without
id, are told apart.  Of a group the row with the smallest (doc_id, hash) stays, rows without id after all others; of rows
equal in both one stays, whichever columns they have besides (the smallest hash of the whole row).

Only rows that go, and kept ones that repeat, are named; up to ``BROADCAST_BYTES`` of names are broadcast and texts stay where they
are.  Beyond, a bit map of at most 32 MB tells the rows that may be named, and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import free_names, own_columns, ship, stored
from aerolytics.llm.decontaminate import bit_map, held_by
from aerolytics.operators.attach import merge_join, row_bytes

#: Parts that a hot key's rows are dealt to.
PARTS = 64
#: Bytes of a side, or of named rows, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def dealt(rows: DataFrame, side: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join a stored side with one row per key; a key that a third of the rows hold spreads over tasks by a hash of ``by``."""
    if side.count() * row_bytes(side.schema) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), keys, how)
    placed = rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    copies = merge_join(side, placed.select(*keys, "_place").distinct(), keys)
    return merge_join(placed, copies, [*keys, "_place"], how).drop("_place")


def decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, th, goes): rows that go, and rows that stay but are repeated, of (doc_id, th, node) and (node, label).

    A node without label is a group of its own.  Stored.
    """
    each = stored(rows.groupBy("doc_id", "th", "node").agg(F.count("*").alias("n")))
    grouped = stored(dealt(each, groups.select("node", "label"), ["node"], "th", "left").select("doc_id", "th", "n", F.coalesce("label", "node").alias("label")))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    best = grouped.groupBy("label").agg(F.min(key).alias("best"), F.count("*").alias("keys"), F.sum("n").alias("rows")).where("rows > 1")
    best = stored(best)
    goes = ~key.eqNullSafe(F.col("best"))
    return stored(dealt(grouped, best, ["label"], "th").select("doc_id", "th", "n", goes.alias("goes")).where("goes or n > 1").select("doc_id", "th", "goes"))


def survivors(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that go; of repeated ones one stays."""
    ship(docs.sparkSession)
    th, id_, their, go, row, order = free_names(docs, "_th", "_id", "_their", "_goes", "_row", "_order")
    verdicts = named.select(F.col("doc_id").alias(id_), F.col("th").alias(their), F.col("goes").alias(go))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(their))
    keyed, own = docs.withColumn(th, text_hash(F.col("text"))), own_columns(docs)
    if verdicts.count() * row_bytes(verdicts.schema) <= BROADCAST_BYTES:
        marked = keyed.join(F.broadcast(verdicts), same, "left")
        stays = marked.where(F.col(go).isNull()).select(*own)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(bit_map(verdicts.select(F.xxhash64(id_, their).alias("hash"))))

        @F.pandas_udf("boolean")
        def maybe(hashes: pd.Series) -> pd.Series:
            return pd.Series(held_by(shared.value, hashes.to_numpy().view(np.uint64)))

        hit = maybe(F.xxhash64("doc_id", th))
        marked = merge_join(keyed.where(hit), verdicts, same, "left")
        stays = keyed.where(~hit).select(*own).union(marked.where(F.col(go).isNull()).select(*own))
    fields = [c for c, f in zip(own, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    repeated = marked.where(~F.col(go)).select(id_, their, F.struct(*own).alias(row), F.xxhash64(*fields).alias(order))
    return stays.union(repeated.groupBy(id_, their).agg(F.min_by(row, order).alias(row)).select(f"{row}.*"))
