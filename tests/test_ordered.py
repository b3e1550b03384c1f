import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolytics.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    parts = [pd.DataFrame({"log_id": log, "seq": np.arange(n), "x": rng.integers(-50, 50, n), "flag": rng.random(n) < 0.1}) for log, n in ((1, 97), (2, 7), (3, 1), (4, 40))]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("size", [1, 7, 10, 1000])
def test_chunks_change_nothing(spark, rows, size):
    df = spark.createDataFrame(rows).repartition(6)
    back = lambda d, c: d.orderBy("log_id", "seq").toPandas()[c].to_numpy(dtype=float)
    by = rows.groupby("log_id")["x"]
    assert np.array_equal(back(ordered.lagged(df, ["log_id"], "seq", {"p": "x"}, size), "p"), by.shift(1).to_numpy(float), equal_nan=True)
    assert np.array_equal(back(ordered.running_sum(df, ["log_id"], "seq", "x", "s", size), "s"), by.cumsum().to_numpy(float))
    known = rows.assign(v=rows["x"].where(rows["flag"])).groupby("log_id")["v"].ffill().to_numpy(float)
    assert np.array_equal(back(ordered.last_known(df, ["log_id"], "seq", F.when(F.col("flag"), F.col("x")), "v", size), "v"), known, equal_nan=True)


@pytest.mark.parametrize("size", [5, 10, 1000])
def test_guests_reach_over_the_edge(spark, rows, size):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows).repartition(6)
    own = Window.partitionBy("log_id", "_chunk").orderBy("seq").rowsBetween(-3, 2)
    found = ordered.with_guests(df, "seq", 3, 2, size).withColumn("s", F.sum("x").over(own)).where("not _guest")
    whole = df.withColumn("s", F.sum("x").over(Window.partitionBy("log_id").orderBy("seq").rowsBetween(-3, 2)))
    pick = lambda d: sorted((r.log_id, r.seq, r.s) for r in d.collect())
    assert pick(found) == pick(whole)
