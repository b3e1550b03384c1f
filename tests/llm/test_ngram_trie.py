import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolytics.llm import ngram_trie as T


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"</s>"]


def brute_force(rows, discount=T.DISCOUNT):
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi, children = Counter(), Counter(), defaultdict(set)
    for x in train:
        uni.update(x)
        for a, b in zip([b"</s>", *x], x):
            bi[a, b] += 1
            children[a].add(b)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in rows:
        x = tokens(t)
        base = [math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x]
        score = 0.0
        for a, w, b in zip([b"</s>", *x], x, base):
            if not uni[a]:
                score += b
            else:
                score += math.log10(max(bi[a, w] - discount, 0) / uni[a] + discount * len(children[a]) / uni[a] * 10**b)
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(x), sum(1 for w in x if uni[w]), n, sum(base), score)
    return out


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (31, 100), (32, 2**60), (33, 7), (5000, 2**40), (4096, 4096)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        seq = T.EliasFano(T.EliasFano.encode(values, "x"), "x")
        if n:
            assert (seq.get(np.arange(n)) == values).all()
            distinct = np.unique(values)
            seq = T.EliasFano(T.EliasFano.encode(distinct, "x"), "x")
            assert (seq.find(distinct) == np.arange(len(distinct))).all()
            other = np.setdiff1d(rng.integers(0, top, 50).astype(np.uint64), distinct)
            assert (seq.find(other) == -1).all()
        else:
            assert (seq.find(np.array([3], np.uint64)) == -1).all()


def test_shards_split_frequent_contexts_by_word():
    trie = T.Trie("", 100, 10, 0, [(0, 0)], {})
    shard = trie.shards(np.array([0, 0, 5_000_000]), np.array([5_000_000, 5_000_000, 10]), np.array([0, 9, 3]))
    assert shard.tolist() == [0, 2, 2]


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 2, "shard_tokens": 30}, {"shard_words": 4, "shard_tokens": 7}])
def test_scores_equal_brute_force(spark, sizes):
    words = "the cat sat on a mat with one more Éclair".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen words here\n\tThe CAT"), (63, "again the cat"), (63, "again the cat")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    trie = T.train(docs.where(~T.held_out()), **sizes)
    assert bool(trie.split) == bool(sizes) and (not sizes or len(trie.first) > 1)
    from pathlib import Path

    assert not sizes or len(list(Path(trie.path.removeprefix("file://"), "successors").iterdir())) > 5
    found = T.score_documents(docs, trie).withColumn("held_out", T.held_out()).collect()
    expected = brute_force(rows)
    assert len(found) == len(rows)
    for r in found:
        held, n, known, total, base, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(score, abs=n / T.STEPS + 1e-9) and r.score <= score + 1e-9


def test_probabilities_add_up_to_at_most_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", "a a a"] * 3)], "doc_id long, text string")
    trie = T.train(docs)
    reader = T.Reader(trie)
    for context in (b"a", b"zz"):
        total = sum(10 ** reader.score(T.Chunk([w], [0], [context], [0]))[2][0] for w in (b"a", b"b", b"c", T.END, b"none"))
        assert 0.99 < total <= 1 + 1e-9


def test_query_shape(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert T.train_and_score(docs).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.train_and_score(docs).collect() == []


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 10)
    text = b"one two three four five six seven"
    assert [w for words, _ in T.tokens_of(text) for w in words] == text.split() + [T.END]


def test_a_reader_lets_go_of_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 3}") for i in range(60)], "doc_id long, text string")
    trie = T.train(docs, shard_words=8, shard_tokens=20)
    whole = T.Reader(trie)
    (chunk,) = T.chunks([b"w1 w2 w3", b"w5 w40 none", b""])
    expected = whole.score(chunk)
    monkeypatch.setattr(T, "OPEN_BYTES", 1)
    tight = T.Reader(trie)
    for a, b in zip(tight.score(chunk), expected, strict=True):
        assert np.allclose(a, b)
    assert len(tight.held) == 1 < len(whole.held)


def test_a_second_attempt_leaves_one_file(tmp_path, monkeypatch):
    from pyarrow import fs

    uri = str(tmp_path / "a" / "x")
    T.write_arrays(uri, {"v": np.arange(3)}, "1")
    T.write_arrays(uri, {"v": np.arange(3)}, "2")
    monkeypatch.setattr(T, "_store", lambda uri: (Stubborn(fs.LocalFileSystem()), uri))
    T.write_arrays(uri, {"v": np.arange(3)}, "3")
    assert [x.name for x in (tmp_path / "a").iterdir()] == ["x"]


class Stubborn:
    """A store whose rename does not replace."""

    def __init__(self, store):
        self.store = store

    def __getattr__(self, name):
        return getattr(self.store, name)

    def move(self, source, target):
        from pyarrow import fs

        if self.store.get_file_info(target).type != fs.FileType.NotFound:
            raise OSError("exists")
        self.store.move(source, target)
