"""Near copies of the pipeline against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolytics.llm import near_copies, simhash, survivors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, text, n):
    out = text.split()
    for at in rng.choice(len(out), n, replace=False):
        out[at] = str(rng.choice(words))
    return " ".join(out)


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_labels(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if (len(a & b) >= 0.8 * len(a | b)) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_stage_drops_edited_copies(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    one = " ".join(rng.choice(words, 300))
    near, far = edited(rng, words, one, 5), edited(rng, words, one, 40)
    prints = [simhash.fingerprint(x.encode()) for x in (one, near)]
    assert (prints[0] ^ prints[1]).bit_count() > simhash.RADIUS
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate((one, near, far))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("bucket, exact", [(near_copies.BUCKET, False), (3, False), (3, True)])
def test_components_equal_all_pairs(spark, monkeypatch, bucket, exact):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in (60, 12, 5):  # groups of edited copies, each of an earlier one
        group = [" ".join(rng.choice(words, 200))]
        while len(group) < n:
            group.append(edited(rng, words, group[int(rng.integers(len(group)))], int(rng.integers(0, 9))))
        texts += group
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    labels = plain_labels(texts)
    assert 10 < len(set(labels)) < len(texts) - 20
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(docs, exact).collect()) == sorted(set(labels))
    assert near_copies.keep_one_of_each(docs.limit(0)).count() == 0


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega one two three four five six"
OTHER = "this text is unlike everything else that stands here"


@pytest.mark.parametrize("limit", [survivors.BROADCAST_BYTES, 0])
def test_unique_texts_stay_whatever_their_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(survivors, "BROADCAST_BYTES", limit)
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `_th.x` int")).collect()), key=str)
    assert kept([(3, WORDS + " tail", 0), (5, WORDS, 1), (5, OTHER, 2)]) == [(3, WORDS + " tail"), (5, OTHER)]
    assert kept([(3, WORDS, 0), (None, WORDS, 1)]) == [(3, WORDS)]
    assert kept([(None, WORDS, 0), (None, WORDS, 0), (None, OTHER, 0), (7, OTHER, 1), (7, OTHER, 1)]) == [(7, OTHER), (None, WORDS)]
    assert kept([(None, None, 0), (None, "", 1), (4, " ", 2)]) == [(4, " ")]


def test_of_equal_rows_one_stays_by_its_other_columns(spark):
    rows = [(1, WORDS, {"k": i}, f"v{i}") for i in range(40)]
    found = [near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, v string").repartition(n)).collect() for n in (1, 7)]
    assert len(found[0]) == 1 and found[0] == found[1]


def test_a_hot_group_spreads_over_tasks(spark, monkeypatch):
    """A third of all rows in one component: neither labels nor verdicts gather them in a task."""
    monkeypatch.setattr(survivors, "BROADCAST_BYTES", 0)
    rows = spark.range(3_000).selectExpr("id as doc_id", "id * 7 as th", "if(id < 1000, 5, id) as node")
    labels = spark.createDataFrame([(5, 4)], "node long, label long")

    placed = survivors.dealt(rows, labels, ["node"], "th")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" in plan
    sizes = rows.withColumn("_place", F.pmod(F.xxhash64("th"), F.lit(survivors.PARTS))).where("node = 5").groupBy("_place").count()
    assert sizes.agg(F.max("count")).head()[0] < 1_000 / 20
    assert survivors.decided(rows, labels).count() == 999


def test_links_that_no_leader_has(spark, monkeypatch):
    """Similar texts of crowded buckets, to none of whose leaders they are compared."""
    monkeypatch.setattr(near_copies, "BUCKET", 1)
    monkeypatch.setattr(near_copies, "star_pairs", lambda crowded: crowded.selectExpr("node as u", "node as v").where("false"))
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    one = " ".join(rng.choice(words, 200))
    texts = [one, edited(rng, words, one, 3), edited(rng, words, one, 30)]
    assert plain_labels(texts) == [0, 0, 2]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(docs).collect()) == [0, 2]


def test_a_large_bucket_is_compared_by_blocks(spark, monkeypatch):
    """Texts of about the threshold's likeness: no row stands for a pair of a large bucket, links are those of all pairs."""
    monkeypatch.setattr(near_copies, "BUCKET", 4)
    monkeypatch.setattr(near_copies, "OUTER_BLOCK", 7)
    monkeypatch.setattr(near_copies, "BLOCK", 11)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    one = " ".join(rng.choice(words, 200))
    texts = [edited(rng, words, one, int(rng.integers(1, 9))).encode() for _ in range(60)]
    found = [near_copies.shingles(t) for t in texts]
    bands = [near_copies.band_keys(f)[0].view(np.int64) for f in found]
    ids = [near_copies.node(t) - (1 << 63) for t in texts]
    nodes = spark.createDataFrame([(i, k.tolist(), len(f)) for i, k, f in zip(ids, bands, found, strict=True)], "node long, keys array<long>, n long")
    sets = spark.createDataFrame([(i, f.view(np.int64).tolist()) for i, f in zip(ids, found, strict=True)], "node long, own array<long>")
    held = near_copies.shared_keys(nodes.select("node", "n", F.explode("keys").alias("key")))
    assert held.where("size > 4").count() > 300
    mixed = near_copies.mixed_keys(held, spark.createDataFrame([(i, min(ids[:20])) for i in ids[:20]], "node long, label long"))
    small = near_copies.unlike_pairs(mixed)
    large = held.where("size > 4").select("key", "node")
    assert small.count() <= mixed.where("size <= 4").count() * 2
    links = [tuple(r) for r in near_copies.verified(small, sets).union(near_copies.block_links(mixed, nodes, sets)).collect()]
    pairs = {(u, v) for i, u in enumerate(ids) for j, v in enumerate(ids) if i < j and np.intersect1d(found[i], found[j]).size * 9 >= (len(found[i]) + len(found[j])) * 4 and (bands[i] == bands[j]).any() and not (i < 20 and j < 20)}
    assert large.count() and all((u, v) in pairs or (v, u) in pairs for u, v in links) and len(links) < len(pairs)

    def groups(edges):
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in [*edges, *[(ids[0], i) for i in ids[1:20]]]:
            root[find(u)] = find(v)
        return {frozenset(i for i in ids if find(i) == find(r)) for r in ids}

    assert groups(links) == groups(pairs) and 1 < len(groups(pairs)) < 41


def test_nodes_meet_further_leaders_only_where_they_are_not_connected(spark, monkeypatch):
    base = list(range(100))
    sets = spark.createDataFrame([(1, base), (2, base[:95]), (3, base[5:]), (4, [*base[:50], *range(200, 250)])], "node long, own array<long>").coalesce(1)
    stars = spark.createDataFrame([(1, 2, 9), (3, 2, 4), (1, 3, 9), (2, 3, 1), (1, 4, 2), (2, 4, 1)], "u long, v long, c long")
    real, met = near_copies.star_links, []
    monkeypatch.setattr(near_copies, "star_links", lambda s, t: met.append(sorted(map(tuple, s.select("u", "v").collect()))) or real(s, t))
    links = {frozenset(r) for r in near_copies.verified_stars(stars, sets).collect()}
    assert met == [[(1, 2), (1, 3), (1, 4)], [(2, 4)]] and links == {frozenset((1, 2)), frozenset((1, 3))}


def test_leaders_of_other_sizes_are_not_proposed(spark):
    crowded = spark.createDataFrame([(7, 1, 100), (7, 2, 90), (7, 3, 10)], "key long, node long, n long")
    assert all({1, 2} == {r.u, r.v} for r in near_copies.star_pairs(crowded).collect())


def test_sets_that_no_pair_needs_stay_where_they_are(spark):
    sets = spark.range(100).selectExpr("id as node", "array(id, id + 1) as own")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_copies.rows_of(sets, spark.createDataFrame([(1,), (1,), (5,)], "node long"))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and sorted(r.node for r in found.collect()) == [1, 5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
