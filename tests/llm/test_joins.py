"""Joins of tables that grow are broadcast by a measured size only, never by Spark's estimate, which doesn't count the rows of an explode."""

import re

import numpy as np
import pytest

from aerolytics.llm import common, components, near_copies, queries, simhash, survivors
from aerolytics.operators import attach


@pytest.fixture
def unsaid(spark, monkeypatch):
    """The joins of the tables that are stored meanwhile whose way is Spark's to choose."""
    found = []

    def recorded(df):
        found.extend(joins(df))
        return common.stored(df)

    for module in (attach, components, near_copies, simhash, survivors):
        monkeypatch.setattr(module, "stored", recorded)
    return found


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in re.findall(r"\bJoin .*", plan) if "Hint=(strategy=" not in x]


def texts(n):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(99)]
    return [(i, " ".join(rng.choice(words, 30 + i % 3))) for i in range(n)] + [(n + i, f"one two three four five six {'x' * (i % 2)}") for i in range(9)]


@pytest.mark.parametrize("limit", [survivors.BROADCAST_BYTES, 0])
def test_links_of_fingerprints(spark, monkeypatch, unsaid, limit):
    monkeypatch.setattr(survivors, "BROADCAST_BYTES", limit)
    found = simhash.link_documents(spark.createDataFrame(texts(30), "doc_id long, text string"))
    assert not unsaid + joins(found)
    assert sorted({r.component_id for r in found.collect()}) == [*range(30), 30, 31]


@pytest.mark.parametrize("limit", [survivors.BROADCAST_BYTES, 0])
def test_links_of_near_copies(spark, monkeypatch, unsaid, limit):
    for module in (survivors, near_copies, attach):
        monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(texts(30), "doc_id long, text string")
    found = near_copies.keep_one_of_each(docs)
    assert not unsaid + joins(found)
    assert sorted(r.doc_id for r in found.collect()) == [*range(30), 30, 31]


def test_exploded_fingerprints_are_no_broadcast(spark):
    points = common.stored(spark.range(2_000).selectExpr("xxhash64(id) as fp"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert "BroadcastExchange" not in simhash.near_edges(points)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_says_how_it_joins(spark, unsaid):
    assert not joins(queries.op8_simhash(spark, "/root/testdata/sf0.001")) + unsaid
