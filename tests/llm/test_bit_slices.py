import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolytics.llm import bit_slices
from aerolytics.llm.common import stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score int, key int", "item_id string, text string, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, text, [(score, doc_id)]) with every score by the formula."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        found = []
        for doc_id, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, r[3], -r[0]) for rank, r in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    dice = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ÉA", "中文", "x1"]
    word = lambda: vocabulary[min(int(dice.zipf(1.3)), 500) % len(vocabulary)]
    docs = [(int(i), " ".join(word() for _ in range(int(dice.integers(0, 120))))) for i in range(500)]
    docs += [(i, docs[5][1]) for i in range(600, 750)]  # a large group of copies: ties by doc_id
    docs += [(7, "W3 w3;w3-w4"), (7, "w3 w4"), (7, "w3 w4"), (None, "w3 w4 w9"), (None, None), (900, None), (901, ""), (902, " .,;"), (903, "w9 " * 20_000)]
    items = [(f"i{j}", " ".join(word() for _ in range(8))) for j in range(12)]
    items += [("copy", docs[5][1]), ("copy", docs[5][1]), ("copy", "w9"), (None, "w4 w3"), ("none", "unheard of"), ("blank", " "), ("null", None), ("case", "éa ÉA W3")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 0, 0) for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, 0) for i in items], ITEMS)


def test_equals_brute_force(spark, tables):
    found = bit_slices.search(*frames(spark, *tables))
    assert sorted(map(tuple, found.collect()), key=str) == brute(*tables)


def test_items_in_parts_and_documents_by_bit_map(spark, tables, monkeypatch):
    monkeypatch.setattr(bit_slices, "QUERY_ITEMS", 5)
    monkeypatch.setattr(bit_slices, "KEYS", 0)
    monkeypatch.setattr(bit_slices, "TERMS", 7)
    monkeypatch.setattr(bit_slices, "BLOCK_DOCS", 21)
    found = bit_slices.search(*frames(spark, *tables))
    assert sorted(map(tuple, found.collect()), key=str) == brute(*tables)


def test_bounds_are_never_below_scores_and_exclude_documents(spark, tables):
    docs, items = frames(spark, *tables)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    queries = bit_slices.Queries(tables[1][:12])
    index = bit_slices.index_documents(rows, queries.terms)
    queries.weigh(index)
    bounds = {}
    for row in index.where("bits is not null").toLocalIterator():
        found = bit_slices.upper_bounds(queries, row.asDict())
        bounds |= {k: found[:, j] for j, k in enumerate(row.keys)}
    above = 0
    for r in rows.distinct().collect():
        c = Counter(bit_slices.words_of((r.text or "").encode()))
        for i, of in enumerate(queries.of):
            m = queries.norms([sum(c.values())])[0]
            names = sorted(queries.terms)
            score = sum(int(queries.weights[t] * bit_slices.impact(c[names[t]], m)) for t in of if c[names[t]])
            bound = bounds[r.key][i] if r.key in bounds else 0
            assert bound >= score
            above += bound > 1.5 * score
    assert above < 0.2 * 12 * rows.count()
    least = np.full(12, 10**12)
    assert bit_slices.not_excluded(index, queries, least).count() == 0
    best = bit_slices.exact_scores(rows, bit_slices.seeds(index, queries), queries)
    for r in best.where("rank = 10").collect():
        least[r.item] = r.score
    assert 0 < bit_slices.not_excluded(index, queries, least).count() < 0.7 * rows.count()


def test_empty_tables(spark, tables):
    docs, items = frames(spark, *tables)
    assert bit_slices.search(docs.where("false"), items).count() == 0
    assert bit_slices.search(docs, items.where("false")).count() == 0
    assert bit_slices.search(stored(docs.where("doc_id > 900")), items).columns == ["item_id", "rank", "doc_id", "score"]
