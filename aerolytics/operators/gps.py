"""GPS frames by each log's own field definitions.

What a field of a GPS frame is added to follows from its predictor code: the latest earlier home position (of two
neighbours that both ask for it, the second takes the home's second value), the time of the latest earlier valid main frame, a constant, or nothing.
Logs of a fleet differ in the order and number of their fields, so codes are data: one map for each log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.operators.attach import attach
from aerolytics.operators.ordered import CHUNK, last_known

# Predictor codes of GPS fields.
FIFTEEN_HUNDRED, HOME_COORD, LAST_MAIN_FRAME_TIME, HOME_COORD_1 = 8, 7, 10, 256


def paired_codes(codes: Column) -> Column:
    """Predictor codes in the order of their fields: of two neighbours with the home position's code the second gets that of its second value."""

    def step(out: Column, code: Column) -> Column:
        second = (F.try_element_at(out, F.lit(-1)) == HOME_COORD) & (code == HOME_COORD)
        return F.concat(out, F.array(F.when(second, F.lit(HOME_COORD_1)).otherwise(code)))

    return F.aggregate(codes, F.array().cast("array<int>"), step)


def gps_codes(definitions: DataFrame) -> DataFrame:
    """(log_id, codes): the predictor code of each field of a log's GPS frames; a field ``GPS_coord[0]`` is called ``GPS_coord_0``."""
    fields = definitions.where("frame_type = 'G'").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.col("predictor").cast("int").alias("code")))).alias("f"))
    names = F.transform("f.name", lambda n: F.regexp_replace(n, r"\[(\d+)\]", "_$1"))
    return fields.select("log_id", F.map_from_arrays(names, paired_codes(F.col("f.code"))).alias("codes"))


def rebuild_gps(gps: DataFrame, homes: DataFrame, main: DataFrame, definitions: DataFrame, rows: int = CHUNK) -> DataFrame:
    """Adds ``<column>_value`` for the residual columns of ``gps`` (log_id, stream_seq, a column for each field).

    ``homes`` is (log_id, stream_seq, home_0, home_1), ``main`` (log_id, stream_seq, valid, time).  Before any home frame a position is added to 0;
    so is a time before any main frame, and after one that isn't valid.  A log that lacks a field has no values of it.  One
    pass over chunks of the three streams together finds both; a long log spreads over tasks.
    """
    fields = [c for c in gps.columns if c not in ("log_id", "stream_seq")]
    home_type, time_type = "struct<x:bigint,y:bigint>", "struct<valid:boolean,time:bigint>"
    of_gps = gps.select("log_id", "stream_seq", F.lit(True).alias("_fix"), F.lit(None).cast(home_type).alias("_home"), F.lit(None).cast(time_type).alias("_main"), F.struct(*fields).alias("_own"))
    empty = F.lit(None).cast(of_gps.schema["_own"].dataType).alias("_own")
    of_home = homes.select("log_id", "stream_seq", F.lit(False), F.struct(F.coalesce(F.col("home_0").cast("bigint"), F.lit(0)).alias("x"), F.coalesce(F.col("home_1").cast("bigint"), F.lit(0)).alias("y")).cast(home_type), F.lit(None).cast(time_type), empty)
    of_main = main.select("log_id", "stream_seq", F.lit(False), F.lit(None).cast(home_type), F.struct(F.col("valid").cast("boolean"), F.col("time").cast("bigint")).cast(time_type), empty)
    both = last_known(last_known(of_gps.union(of_home).union(of_main), ["log_id"], "stream_seq", F.col("_home"), "_at_home", rows), ["log_id"], "stream_seq", F.col("_main"), "_at_main", rows).where("_fix")
    ruled = attach(both.select("log_id", "stream_seq", "_own.*", "_at_home", "_at_main"), gps_codes(definitions), order="stream_seq", how="left")

    def value(column: str) -> Column:
        code, zero = F.try_element_at("codes", F.lit(column)), F.lit(0).cast("bigint")
        time = F.when(F.col("_at_main.valid"), F.col("_at_main.time"))
        added = F.when(code == HOME_COORD, F.col("_at_home.x")).when(code == HOME_COORD_1, F.col("_at_home.y")).when(code == LAST_MAIN_FRAME_TIME, time).when(code == FIFTEEN_HUNDRED, F.lit(1500).cast("bigint"))
        return F.when(code.isNotNull(), F.col(column).cast("bigint") + F.coalesce(added, zero)).alias(f"{column}_value")

    return ruled.select("log_id", "stream_seq", *fields, *[value(c) for c in fields])
