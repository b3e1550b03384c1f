"""Recall of the near-copy links against all pairs of similar texts.

By default over the small tables, every text a query.  ``NEAR_COPIES_DIR`` names another folder, of which every
``NEAR_COPIES_STEP``-th text is a query against all others; the figures are printed (``pytest -s``).
"""

import os

import numpy as np

from aerolytics.llm import near_copies

FOLDER = os.environ.get("NEAR_COPIES_DIR", "/root/testdata/sf0.1")
STEP = int(os.environ.get("NEAR_COPIES_STEP", "1"))
#: Least similarity of each class that is told apart.
CLASSES = [0.8, 0.82, 0.85, 0.9, 0.95]


def similar_pairs(texts, step):
    """(a, b, similarity) of the distinct texts with a Jaccard similarity of 0.8 or more, a among the queries."""
    sets = [near_copies.shingles(t) for t in texts]
    sizes = np.array(list(map(len, sets)))
    of = np.repeat(np.arange(len(sets)), sizes)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, of = hashes[order], of[order]
    for a in range(0, len(sets), step):
        low, high = np.searchsorted(hashes, sets[a], "left"), np.searchsorted(hashes, sets[a], "right")
        met = np.concatenate([of[x:y] for x, y in zip(low, high, strict=True)] + [np.zeros(0, np.int64)])
        both = np.bincount(met, minlength=len(sets))
        share = both / np.maximum(sizes + sizes[a] - both, 1)
        part, whole = near_copies.SIMILAR
        for b in np.flatnonzero((both * (whole + part) >= (sizes + sizes[a]) * part) & (sizes > 0)).tolist():
            if b != a and (b > a or b % step):
                yield a, b, share[b]


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {near_copies.node((r.text or "").encode()): (r.text or "").encode() for r in docs.select("text").toLocalIterator()}
    rows, labels = near_copies.link_near_copies(docs)
    label = {int(np.int64(r.node)): r.label for r in labels.collect()}
    nodes = [int(np.array(n, np.uint64).view(np.int64)) for n in texts]
    tables = [[], [], []]
    keys = [near_copies.band_keys(near_copies.shingles(t))[0].tolist() for t in texts.values()]
    count = {}
    for k in (k for own in keys for k in own):
        count[k] = count.get(k, 0) + 1
    for a, b, share in similar_pairs(list(texts.values()), STEP):
        shared = [count[k] for k in set(keys[a]) & set(keys[b])]
        place = 2 if not shared else int(min(shared) > near_copies.BUCKET)
        tables[place].append((share, label.get(nodes[a], nodes[a]) == label.get(nodes[b], nodes[b])))
    pairs = [p for t in tables for p in t]
    for name, own in zip(("meet in a bucket up to the limit", "meet in crowded buckets only", "meet in no band", "all"), (*tables, pairs), strict=True):
        classes = [[ok for s, ok in own if low <= s and (low == CLASSES[-1] or s < CLASSES[i + 1])] for i, low in enumerate(CLASSES)]
        print(f"{name}: " + ", ".join(f"from {low}: {sum(c)} of {len(c)}" for low, c in zip(CLASSES, classes, strict=True)))
    assert len(pairs) > 20 and sum(ok for _, ok in pairs) >= 0.99 * len(pairs)
    assert all(sum(ok for _, ok in t) >= 0.9 * len(t) for t in tables[:2])
    # Nothing is linked that no chain of similar texts connects: with every text a query, all pairs are known.
    if STEP == 1:
        root = {n: n for n in nodes}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b, _ in similar_pairs(list(texts.values()), 1):
            root[find(nodes[a])] = find(nodes[b])
        assert len({(find(n), label[n]) for n in label}) == len({find(n) for n in label})
