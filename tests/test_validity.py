"""Validity by chunks: summaries, entries and the two passes against the plain fold."""

from dataclasses import astuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolytics.operators import validity
from aerolytics.operators.validity import Fold, leave, summarise, validate_logs

SCHEMA = "log_id long, stream_seq long, kind string, iteration long, time32 long"
MIXES = [[10, 30, 20, 20, 10, 4, 2, 2, 1, 1], [5, 50, 30, 10, 3, 0.5, 0.5, 0.5, 0.3, 0.2], [3, 50, 30, 17, 0, 0, 0, 0, 0, 0], [30, 20, 10, 10, 5, 10, 10, 2, 2, 1]]


def stream(seed):
    """A stream with resume events, unreadable bytes, jumps and times that run over, some of them corrupt."""
    dice = np.random.default_rng(seed)
    n, mix = int(dice.integers(1, 700)), np.array(MIXES[seed % 4])
    kind = dice.choice(list("IPPPPR?BGH"), p=mix / mix.sum(), size=n)
    if dice.random() < 0.2:
        kind[int(dice.integers(0, n))] = "E"
    iteration = np.maximum(np.cumsum(dice.integers(0, 40, n) + np.where(dice.random(n) < 0.02, dice.integers(-50, 9_000, n), 0)), 0)
    iteration = np.where(dice.random(n) < 0.01, dice.integers(0, 2**32, n), iteration)
    scale = int(dice.choice([100, 1_000, 100_000, 3_000_000]))
    time = 2**32 - int(dice.integers(0, 200)) * scale // 2 + np.cumsum(dice.integers(0, scale, n))
    time = np.where(dice.random(n) < 0.02, dice.integers(0, 2**32, n), time) % 2**32
    return dice, kind, iteration, time


@pytest.mark.parametrize("raw", [False, True])
def test_summaries_give_the_folds_states(raw):
    for seed in range(250):
        dice, kind, iteration, time = stream(seed)
        n = len(kind)
        cuts = np.unique(np.r_[0, dice.integers(0, n, int(dice.integers(0, 7))), n])
        state, fold = astuple(Fold())[:5], Fold(raw=raw)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            state = leave(state, summarise(kind[a:b], iteration[a:b], time[a:b], raw), raw)
            fold.run(kind[a:b], iteration[a:b], time[a:b])
            assert tuple(map(int, state)) == tuple(map(int, astuple(fold)[:5])), (seed, a, b)


def test_a_summary_is_small():
    n = 60_000
    kind = np.where(np.arange(n) % 32 == 0, "I", "P")
    made = summarise(kind, np.arange(n) * 4, 50_000_000 + np.arange(n) * 1_000)
    assert len(made["kinds"]) <= n / 32 + 1 and len(made["exits"]) == 1


@pytest.mark.parametrize("raw", [False, True])
def test_chunks_equal_one_fold(spark, raw):
    rows, expected = [], {}
    for log in range(8):
        _, kind, iteration, time = stream(100 + log)
        rows += [(log, s, str(k), int(i), int(t)) for s, (k, i, t) in enumerate(zip(kind, iteration, time, strict=True))]
        found, times = Fold(raw=raw).run(kind, iteration, time)
        expected |= {(log, s): (None if v < 0 else v == 1, int(t)) for s, (v, t) in enumerate(zip(found, times, strict=True))}
    rows += [(None, 0, "I", 1, 1), (9, None, "I", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size in (19, 100_000):
        found = {(r.log_id, r.stream_seq): (r.valid, r.time) for r in validate_logs(df, raw, rows=size).collect()}
        assert found == expected
    assert validate_logs(df.where("false"), raw).count() == 0


def test_a_giant_log_spreads_over_tasks(spark):
    """Rows are dealt by (log, chunk); by log alone only the chunks' summaries are."""
    df = spark.range(4_000).selectExpr("1L as log_id", "id as stream_seq", "if(id % 32 = 0, 'I', 'P') as kind", "id * 4 as iteration", "id * 1000 as time32")
    found = validate_logs(df, rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_log = [line for line in plan.split("\n") if "Exchange hashpartitioning(log_id" in line and "_chunk" not in line]
    assert len(by_log) == 1 and "_chunk" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 2_000
    assert found.where("valid").count() == 4_000


def test_a_long_stretch_without_valid_frames_keeps_its_reference():
    """A state passes through chunks where no frame fits, and a resume event brings it back."""
    state = (True, 10, 1_000_000, False, 0)
    dead = summarise(np.array(["I", "P"] * 40), np.full(80, 900_000), np.full(80, 2_000_000))
    assert leave(state, dead)[:3] == (False, 10, 1_000_000)
    back = summarise(np.array(["R", "P", "I", "P"]), np.array([900_000] * 4), np.array([2_000_000] * 4))
    assert leave(leave(state, dead), back) == (True, 900_000, 2_000_000, False, 0)
    assert validity.SUMMARY.count("array") == 5
