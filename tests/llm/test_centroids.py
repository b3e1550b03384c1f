import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from aerolytics.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int"


def brute(rows, k, rounds, scale, seed):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    held = [q for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(held))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(held)):
            own = [q for (_, q), c in zip(kept, of, strict=True) if c == j]
            if own:
                held[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    total = {j: sum(d for _, c, d in found if c == j) for j in range(len(held))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in held]
    return sorted(((i, c, d, total[c], sum(total.values()), text[c]) for i, c, d in found), key=str)


def test_equals_brute_force_with_odd_rows(spark):
    dice = np.random.default_rng(5)
    rows = [(i, dice.normal(size=3).round(2).tolist()) for i in range(200)]
    rows += [(7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (None, [0.25, -1.0, 3.0])]  # repeated and absent ids
    rows += [(1000 + i, [1.0, 1.0, -1.0]) for i in range(150)]  # a hot group
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [1.0, float("-inf"), 2.0]), (906, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], SCHEMA)
    found, held = centroids.cluster_vectors(df, k=9, rounds=3, dims=3)
    assert len(held) == 9
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 9, 3, centroids.SCALE, centroids.SEED)


def test_an_empty_cluster_keeps_its_centroid_and_few_vectors_make_few_clusters(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 5.0])]
    found, held = centroids.cluster_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), k=40, rounds=2, dims=2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 40, 2, centroids.SCALE, centroids.SEED)
    assert len(held) == 3  # two of them equal; the later one has no vector


def test_empty_tables_and_large_components(spark):
    found, held = centroids.cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and held == [] and found.columns[0] == "vec_id"
    with pytest.raises(PySparkException, match="component"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0], 0)], SCHEMA), dims=2)


def test_no_python_and_no_shuffle_of_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(10)], SCHEMA)
    found, _ = centroids.cluster_vectors(df, k=3, dims=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
