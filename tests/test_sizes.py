"""What a task holds doesn't grow with the table: partitions by rows, and batches by bytes."""

import pytest
from pyspark.sql import functions as F

from aerolytics.operators import ordered, stats
from aerolytics.plans import telemetry
from aerolytics.ship import BATCH_BYTES, ship


@pytest.fixture
def settings(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    yield spark.conf
    for n, v in before.items():
        spark.conf.set(n, v)


def test_frames_of_larger_tables_have_more_partitions(spark, settings):
    table = spark.range(2_000).select((F.col("id") % 100).alias("l_suppkey"))
    settings.set("spark.sql.shuffle.partitions", "8")
    assert telemetry.dealt_by_log(table, "l_suppkey", 1_000) is table and settings.get("spark.sql.shuffle.partitions") == "8"
    dealt = telemetry.dealt_by_log(table, "l_suppkey", 50)
    assert dealt.rdd.getNumPartitions() == 40 and settings.get("spark.sql.shuffle.partitions") == "40"
    assert telemetry.dealt_by_log(table, "l_suppkey", 100).rdd.getNumPartitions() == 40
    assert dealt.groupBy(F.spark_partition_id(), "l_suppkey").count().count() == 100  # a log is in one partition



def test_python_stages_get_batches_of_bounded_bytes(spark, settings):
    settings.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    ship(spark)
    assert settings.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES) and int(settings.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_rows_stay_where_they_are_when_a_chunk_meets_those_before(spark):
    rows = spark.range(500).select((F.col("id") % 5).alias("log_id"), F.floor(F.col("id") / 5).alias("i"), F.lit(1).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ordered.running_sum(rows, ["log_id"], "i", "x", "s", rows=10)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("s <> i + 1").isEmpty() and found.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compared_responses_read_their_rows_once(spark, tmp_path):
    from aerolytics.operators import spectral

    rows = spark.range(400).selectExpr("1L as log_id", "id as frame_seq", "'roll' as axis", "id / 100.0D as time_s", "id % 90 * 5 as setpoint", "id % 90 * 5 as gyro")
    rows.write.parquet(str(tmp_path / "rows"))
    catalog = spark.createDataFrame([(1, 0.0, 4.0, True)], "log_id long, time_start_s double, time_end_s double, visible boolean")
    found = spectral.compare_responses(spark.read.parquet(str(tmp_path / "rows")), catalog)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert not found.where("n_segments > 0").isEmpty()


def test_missing_numbers_are_filled_in_without_a_grid(spark):
    rows = [("a", 0, 4), ("a", 3, 5), ("a", 3, 6), ("b", 4, None), ("c", -2, 1), ("c", 5, 1), ("d", 9, 2), (None, 1, 7)]
    found = stats.dense(spark.createDataFrame(rows, "k string, n int, count long"), ["k"], "n", 5, {"count": 0})
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row of the grid is shuffled or sorted
    assert found.dtypes == [("k", "string"), ("n", "int"), ("count", "bigint")]
    expected = [(k, n, c) for k in ("a", "b", "c", "d", None) for n in range(5) for c in ([r[2] or 0 for r in rows if r[:2] == (k, n)] or [0])]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
