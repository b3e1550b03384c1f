"""Telemetry views over the driver's tables: frames, header lines, raw frames and event streams.

The SQL of each view runs unchanged in Spark and in DuckDB, so queries and their oracles start
from the same rows.  One log is one supplier; frames are integers at 100 Hz.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "b": """select l_suppkey as log_id,
        cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as bigint) as frame_seq,
        cast(l_partkey % 801 as bigint) - 400 as setpoint_roll, cast(floor(l_extendedprice) as bigint) % 801 - 400 as setpoint_pitch,
        cast(l_orderkey % 401 as bigint) - 200 as setpoint_yaw, cast(l_quantity as bigint) as q, l_partkey as pk,
        cast(floor(l_extendedprice) as bigint) as ep, l_orderkey as ok
      from lineitem""",
    "frames": """select log_id, frame_seq, frame_seq * 4 as loop_iteration, 1000000 + frame_seq * 10000 as time, setpoint_roll, setpoint_pitch, setpoint_yaw,
        coalesce(lag(setpoint_roll, 2) over (partition by log_id order by frame_seq), 0) + q - 25 as gyro_roll,
        coalesce(lag(setpoint_pitch, 2) over (partition by log_id order by frame_seq), 0) + q - 25 as gyro_pitch,
        coalesce(lag(setpoint_yaw, 2) over (partition by log_id order by frame_seq), 0) + q - 25 as gyro_yaw,
        (pk * 13) % 1201 - 600 as rc_roll, (ep * 3) % 1001 - 500 as rc_pitch, (ok * 7) % 801 - 400 as rc_yaw, q * 20 as throttle, 48 + (pk * 3) % 2000 as motor_0, 48 + (pk * 5) % 2000 as motor_1, 48 + (pk * 7) % 2000 as motor_2, 48 + (pk * 11) % 2000 as motor_3
      from b""",
    "signals": """select log_id, frame_seq, time, 'roll' as axis, gyro_roll as gyro, setpoint_roll as setpoint from frames
      union all select log_id, frame_seq, time, 'pitch', gyro_pitch, setpoint_pitch from frames
      union all select log_id, frame_seq, time, 'yaw', gyro_yaw, setpoint_yaw from frames""",
    "header_lines": """select s_suppkey as log_id, 1 as line_no, concat('H Firmware type:', case when s_suppkey % 4 = 0 then 'Other' else 'Cleanflight' end) as line from supplier
      union all select s_suppkey, 2, concat('H Firmware revision:Betaflight 4.', cast(s_suppkey % 6 as varchar(9)), '.1') from supplier where s_suppkey % 4 <> 0
      union all select s_suppkey, 3, 'H gyro_scale:0x3f800000' from supplier
      union all select s_suppkey, 4, 'H Field I name:loopIteration,time,gyroADC[0],motor[0]' from supplier
      union all select s_suppkey, 5, 'H Field I signed:0,0,1,0' from supplier
      union all select s_suppkey, 6, 'H Field P predictor:6,2,1,3' from supplier
      union all select s_suppkey, 7, concat('H minthrottle:', cast(1000 + s_suppkey % 100 as varchar(9))) from supplier
      union all select s_suppkey, 8, 'H maxthrottle:2000' from supplier
      union all select s_suppkey, 9, concat('H motorOutput:', cast(40 + s_suppkey % 9 as varchar(9)), ',2047') from supplier
      union all select s_suppkey, 10, concat('H minthrottle:', cast(900 + s_suppkey % 50 as varchar(9))) from supplier where s_suppkey % 3 = 0
      union all select s_suppkey, 11, concat('H rollPID:', cast(40 + s_suppkey % 10 as varchar(9)), ',80,', cast(30 + s_suppkey % 20 as varchar(9))) from supplier
      union all select s_suppkey, 12, 'H pitchPID:47,84,46' from supplier
      union all select s_suppkey, 13, 'H yawPID:45,80' from supplier where s_suppkey % 7 <> 0
      union all select s_suppkey, 14, case when s_suppkey % 2 = 1 then 'H ff_weight:120' else 'H ff_weight:120,125,120' end from supplier
      union all select s_suppkey, 15, concat('H vbatref:', cast(1500 + (s_suppkey * 37) % 2500 as varchar(9))) from supplier
      union all select s_suppkey, 16, 'H vbatcellvoltage:33,35,43' from supplier
      union all select s_suppkey, 17, concat('H currentMeter:', cast(s_suppkey % 500 as varchar(9)), ',400') from supplier
      union all select s_suppkey, 18, 'H no separator here' from supplier
      union all select s_suppkey, 19, 'H Data version:2' from supplier
      union all select s_suppkey, 20, concat('H rcRate:', cast(80 + s_suppkey % 40 as varchar(9))) from supplier
      union all select s_suppkey, 21, concat('H acc_1G:', case when s_suppkey % 10 = 0 then 'oops' else cast(2048 + s_suppkey % 3 as varchar(9)) end) from supplier
      union all select s_suppkey, 22, concat('H vbatscale:', cast(100 + s_suppkey % 20 as varchar(9))) from supplier
      union all select s_suppkey, 23, concat('H I interval:', cast(s_suppkey % 40 as varchar(9))) from supplier
      union all select s_suppkey, 24, concat('H P interval:', case when s_suppkey % 6 = 0 then '4' else concat('1/', cast(1 + s_suppkey % 8 as varchar(9))) end) from supplier
      union all select s_suppkey, 25, concat('H Log start datetime:', case when s_suppkey % 5 = 0 then 'none' else concat('2024-01-1', cast(s_suppkey % 9 as varchar(9)), 'T10:20:30') end) from supplier
      union all select s_suppkey, 26, concat('H gyro_scale:', case s_suppkey % 9 when 1 then '0x3a83126f' when 4 then '0xba83126f' else 'zz' end) from supplier where s_suppkey % 3 = 1""",
    "raw_base": """select log_id, frame_seq, loop_iteration, gyro_roll as x, lag(gyro_roll, 1) over (partition by log_id order by frame_seq) as p1,
        lag(gyro_roll, 2) over (partition by log_id order by frame_seq) as p2 from frames""",
    "raw_frames": """select log_id, frame_seq as stream_seq, case when frame_seq % 32 = 0 then 'I' else 'P' end as frame_type,
        case when frame_seq = 100 then cast(0 as bigint) else loop_iteration end as loop_iteration,
        (4291967296 + frame_seq * 10000 + case when log_id % 4 = 0 and frame_seq >= 400 then 20000000 else 0 end) % 4294967296 as time32,
        case when frame_seq % 32 = 0 then x else x - p1 end as d_prev,
        case when frame_seq % 32 = 0 then x else x - 2 * p1 + case when frame_seq % 32 = 1 then p1 else p2 end end as d_line,
        case when frame_seq % 32 = 0 then x else x - cast(floor((p1 + case when frame_seq % 32 = 1 then p1 else p2 end) / 2.0) as bigint) end as d_avg
      from raw_base""",
    "stream": """select log_id, stream_seq,
        case when log_id % 5 = 1 and stream_seq = 150 then '?' when log_id % 5 = 2 and stream_seq = 200 then 'R' when log_id % 5 = 4 and stream_seq = 500 then 'E'
             when log_id % 5 = 0 and stream_seq = 250 then 'B' else frame_type end as kind,
        loop_iteration + case when log_id % 5 = 2 and stream_seq >= 200 then 20000 when log_id % 7 = 3 and stream_seq >= 260 then 6000 else 0 end as iteration,
        case when log_id % 5 = 3 and stream_seq in (301, 330) then cast(4294967290 as bigint) else time32 end as time32
      from raw_frames""",
    "delta_base": """select log_id, frame_seq, frame_seq % 32 = 0 as whole, motor_0 as m0, motor_1 as m1, gyro_roll as g, (4294967000 + frame_seq * 7) % 4294967296 as u, 5000000000 + frame_seq * frame_seq * 3 as w,
        1000 + log_id % 100 as minthrottle, 40 + log_id % 9 as motor_output_low, 1500 + (log_id * 37) % 2500 as vbatref, lag(motor_0) over (partition by log_id order by frame_seq) as m0_1,
        lag(motor_1) over (partition by log_id order by frame_seq) as m1_1, lag(motor_1, 2) over (partition by log_id order by frame_seq) as m1_2
      from frames""",
    "deltas": """select log_id, frame_seq as stream_seq, case when whole then 'I' else 'P' end as frame_type, minthrottle, motor_output_low, vbatref,
        case when whole then m0 - minthrottle else m0 - m0_1 end as motor_0, case when whole then m1 - m0 else m1 - cast(floor((m1_1 + case when frame_seq % 32 = 1 then m1_1 else m1_2 end) / 2.0) as bigint) end as motor_1,
        case when whole then u else 7 end as ticks, case when whole then w else case when frame_seq % 32 = 1 then 3 * (2 * frame_seq - 1) else 6 end end as far,
        case when whole then g - 1500 else g - vbatref end as level, case when whole then g - motor_output_low else g - m0 end as mixed
      from delta_base""",
    "sticks": """select log_id, 'roll' as axis, abs(rc_roll) / cast(500 as double) * 100 as pct from frames union all select log_id, 'pitch', abs(rc_pitch) / cast(500 as double) * 100 from frames union all select log_id, 'yaw', abs(rc_yaw) / cast(500 as double) * 100 from frames""",
    "streams": """select user_id as log_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as stream_seq, event_type,
        event_id, event_id % 1000 as a, event_id % 777 as c from events""",
    "catalog": """select s_suppkey as log_id, cast((s_suppkey % 5) * 0.25 as double) as time_start_s, cast(3.0 + (s_suppkey % 7) * 0.5 as double) as time_end_s, s_suppkey % 9 <> 0 as visible from supplier""",
}
NEEDS = {
    "b": ["lineitem"], "frames": ["b"], "signals": ["frames"], "header_lines": ["supplier"], "raw_base": ["frames"], "raw_frames": ["raw_base"],
    "stream": ["raw_frames"], "delta_base": ["frames"], "deltas": ["delta_base"], "sticks": ["frames"], "streams": ["events"], "catalog": ["supplier"],
}


#: Columns that deal a large table's rows to tasks by log.
DEALT = {"lineitem": "l_suppkey", "events": "user_id"}
#: Rows of such a table that a task of a shuffle has, about.
PARTITION_ROWS = 250_000


def dealt_by_log(table: DataFrame, key: str, rows: int = PARTITION_ROWS) -> DataFrame:
    """The table in as many partitions by ``key`` as its rows need, so that a task's memory doesn't grow with the table.

    The session's later shuffles get as many; a number that is higher already stays, and a table that the session's cores hold at once is left as it is.
    """
    spark = table.sparkSession
    needed = -(-table.count() // rows)  # from the files' footers
    if needed <= spark.sparkContext.defaultParallelism:
        return table
    number = max(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    return table.repartition(number, key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: dealt_by_log(view(spark, sf_dir, n), DEALT[n]) if n in DEALT else view(spark, sf_dir, n) for n in NEEDS[name]}
    text = VIEWS[name]
    for n in parts:
        text = text.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(text, **parts)


def with_views(*names: str) -> str:
    """The ``with`` clause that gives DuckDB the views and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in NEEDS[name]:
                need(n)
            order.append(name)

    for n in names:
        need(n)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
