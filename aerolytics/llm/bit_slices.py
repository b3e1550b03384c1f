"""Ranked lexical search over bit-sliced Bloom signatures.

Index: a document's signature holds its terms, and each term once more for every power of two that its count reaches
(2, 4, 8 ...), at ``PROBES`` bits each.  Documents with signatures of one width form blocks; a block is stored by slices: one bitmap
over its documents for each bit of the signature, beside their lengths and largest counts.

Search: the bitmaps of a term's bits, and-ed, overestimate which documents hold it, and those of its powers how
often at most.  Sums of the slices, each weighted with what its count adds to the score at the document's length, are upper
bounds of all scores.  The documents with the highest bounds of each item are scored exactly, which gives a threshold for
each item; every document whose bound reaches the threshold of any item is read again and scored exactly, so that
nothing is left out that could be in a result.  Scores are 64-bit integers.

The given items are taken in blocks of bounded size, each against all rows.  Index, bounds and scores are made where rows are: a
task gives its blocks, its keys and its best rows of each item, so no term, document or item is ever gathered in one place; ranks are taken
over at most k rows of a task for each item.  Documents are known by a hash of id and text, and read again by a broadcast of
at most ``KEYS`` keys, else by a bit map of at most 32 MB that lets some more rows through, which are scored as well.

Edge cases: null texts and texts without terms have no score; items without terms, or whose terms no document holds,
have no rows; items that repeat id and text are one, and of those that repeat the id alone each has ranks of its own; documents
that repeat an id are ranked one by one, those without id after others of their score.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.llm.common import ship, small_batches, stored, utf8_rows
from aerolytics.llm.decontaminate import bit_map, held_by, words_of

TOP, SEEDS = 10, 30
#: Bits of a signature for each entry (at least; at most twice as many), and bits that an entry sets.
EACH, PROBES = 12, 5
#: Powers of two that a count is held by: 1, 2, 4 ... 32.
LEVELS = 6
#: Bits and documents of a block.
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 2_048
#: Bytes of item texts, and items, that are searched for at once; terms that a block is asked for at once.
QUERY_BYTES, QUERY_ITEMS, TERMS = 16 << 20, 2_000, 2_048
#: Keys that may be broadcast.
KEYS = 1 << 20
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]
_FACTORS = np.array(_ODD[:PROBES], np.uint64)
_STEP = np.uint64(0xA0761D6478BD642F)


def probes(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """For each hash and level, ``PROBES`` numbers of 64 bits whose upper bits are places in a signature of any width."""
    mixed = hashes + levels.astype(np.uint64) * _STEP
    mixed = mixed ^ (mixed >> np.uint64(29))
    return mixed[..., None] * _FACTORS


def term_hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64)


def width_of(entries: int) -> int:
    """Bits (as a power of two) of a signature that holds so many entries."""
    return max(6, (entries * EACH - 1).bit_length())


# ---- the index ----

INDEX = "bits int, keys array<long>, lengths array<long>, tops array<long>, slices binary, docs long, words long, found array<struct<term:int,n:long>>"


class _Block:
    def __init__(self, bits: int):
        self.bits, self.places, self.keys, self.lengths, self.tops = bits, [], [], [], []

    def add(self, key: int, length: int, top: int, places: np.ndarray) -> bool:
        """Whether the block is full then."""
        self.places.append(np.unique(places).astype(np.uint32))
        self.keys.append(key)
        self.lengths.append(length)
        self.tops.append(top)
        return len(self.keys) >= BLOCK_DOCS or len(self.keys) << self.bits >= BLOCK_BITS

    def row(self) -> dict:
        wide = -(-len(self.keys) // 8) * 8
        flags = np.zeros((1 << self.bits) * wide, bool)
        of = np.repeat(np.arange(len(self.keys)), list(map(len, self.places)))
        flags[np.concatenate(self.places).astype(np.int64) * wide + of] = True
        return {"bits": self.bits, "keys": self.keys, "lengths": self.lengths, "tops": self.tops, "slices": np.packbits(flags, bitorder="little").tobytes()}


def index_documents(docs: DataFrame, terms: dict[bytes, int], slices: bool = True) -> DataFrame:
    """The index blocks of ``docs`` (key, text), and rows with counts: documents and words, and in how many documents each of ``terms`` is.  Stored.

    Without ``slices`` there are counts only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        found, count, total = np.zeros(len(asked), np.int64), 0, 0
        open_blocks: dict[int, _Block] = {}
        pack = lambda row: pa.RecordBatch.from_pylist([row], schema=schema)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), utf8_rows(batch.column("text")), strict=True):
                words = words_of(text)
                if not words:
                    continue
                held = Counter(words)
                count += 1
                total += len(words)
                for term in held.keys() & asked.keys():
                    found[asked[term]] += 1
                if not slices:
                    continue
                times = np.fromiter(held.values(), np.int64, len(held))
                hashes = term_hashes(held)
                more = [np.flatnonzero(times >= 1 << level) for level in range(LEVELS)]
                entries = sum(map(len, more))
                bits = width_of(entries)
                made = np.concatenate([probes(hashes[at], np.full(len(at), level)) for level, at in enumerate(more)])
                block = open_blocks.setdefault(bits, _Block(bits))
                if block.add(key, len(words), int(times.max()), (made >> np.uint64(64 - bits)).reshape(-1)):
                    yield pack(open_blocks.pop(bits).row())
        for block in open_blocks.values():
            yield pack(block.row())
        at = np.flatnonzero(found)
        yield pack({"docs": count, "words": total, "found": [{"term": int(t), "n": int(found[t])} for t in at]})

    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    return stored(docs.select("key", "text").mapInArrow(run, INDEX))


# ---- items, weights, scores ----


class Queries:
    """Distinct terms of a block of items, and after ``weigh`` what the corpus says of them."""

    def __init__(self, items: list[tuple]):
        self.items = [i[:2] for i in items]
        words = [sorted(set(words_of((text or "").encode()))) for _, text in self.items]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*words)))}
        self.of = [np.array([self.terms[t] for t in w], np.int64) for w in words]
        self.docs = self.words = 0
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, index: DataFrame) -> None:
        counts = index.where("docs is not null")
        total = counts.agg(F.sum("docs").alias("n"), F.sum("words").alias("l")).head()
        self.docs, self.words = total.n or 0, total.l or 0
        for r in counts.select(F.explode("found").alias("f")).groupBy("f.term").agg(F.sum("f.n").alias("n")).collect():  # at most the block's terms
            self.weights[r.term] = math.floor(1000 * math.log((2 * self.docs + 2) / (2 * r.n + 1)))

    def norms(self, lengths) -> np.ndarray:
        """m of documents of the given lengths."""
        return np.array([100 - 90 + (90 * n * self.docs) // self.words for n in lengths], np.int64)


def impact(times, norm):
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


def upper_bounds(queries: Queries, row: dict) -> np.ndarray:
    """(items, documents of the block): sums of weighted slices, never below a score."""
    n = len(row["keys"])
    bits, wide = row["bits"], -(-n // 8)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(1 << bits, wide)
    norms, tops = queries.norms(row["lengths"]), np.array(row["tops"], np.int64)
    worth = np.zeros((LEVELS + 1, n), np.int64)  # by the number of levels that a count may have reached
    for level in range(LEVELS):
        most = np.minimum((2 << level) - 1, tops) if level + 1 < LEVELS else tops
        worth[level + 1] = impact(np.maximum(most, 1), norms)
    bounds, docs = np.zeros((len(queries.items), n), np.int64), np.arange(n)
    hashes, levels = term_hashes(queries.terms), np.arange(LEVELS)
    for low in range(0, len(hashes), TERMS):
        own = hashes[low : low + TERMS]
        places = (probes(own[:, None], levels[None, :]) >> np.uint64(64 - bits)).astype(np.int64)
        there = slices[places[..., 0]]
        for probe in range(1, PROBES):
            there &= slices[places[..., probe]]
        reached = np.zeros((len(own), n), np.uint8)
        held = np.flatnonzero(there[:, 0].any(axis=1))
        upto = there[held, 0]
        for level in range(LEVELS):  # a level counts only above all lower ones
            upto = upto & there[held, level]
            if not upto.any():
                break
            reached[held] += np.unpackbits(upto, axis=1, count=n, bitorder="little")
        parts = worth[reached, docs] * queries.weights[low : low + TERMS, None]
        for i, of in enumerate(queries.of):
            of = of[np.searchsorted(of, low) : np.searchsorted(of, low + TERMS)] - low
            if len(of):
                bounds[i] += parts[of].sum(axis=0)
    return bounds


def seeds(index: DataFrame, queries: Queries, count: int = SEEDS) -> DataFrame:
    """(key) of the documents with the highest bounds of each item."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        best_bound, best_key = np.zeros((len(q.items), 0), np.int64), np.zeros((len(q.items), 0), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                bounds = upper_bounds(q, row)
                both = np.concatenate([best_bound, bounds], axis=1)
                keys = np.concatenate([best_key, np.broadcast_to(np.array(row["keys"], np.int64), bounds.shape)], axis=1)
                if both.shape[1] > count:
                    at = np.argpartition(-both, count - 1, axis=1)[:, :count]
                    both, keys = np.take_along_axis(both, at, 1), np.take_along_axis(keys, at, 1)
                best_bound, best_key = both, keys
        item, place = np.nonzero(best_bound)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best_key[item, place]), pa.array(best_bound[item, place])], ["item", "key", "bound"])

    found = _blocks(index).mapInArrow(run, "item int, key long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= count).select("key").distinct()


def not_excluded(index: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """(key) of the documents whose bound reaches the least score of any item."""
    shared = index.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, low = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"], np.int64)[(upper_bounds(q, row) >= low[:, None]).any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    return _blocks(index).mapInArrow(run, "key long").distinct()


def _blocks(index: DataFrame) -> DataFrame:
    """Index blocks, a few in a batch."""
    small_batches(index.sparkSession)
    return index.where("bits is not null").select("bits", "keys", "lengths", "tops", "slices")


def exact_scores(docs: DataFrame, keys: DataFrame, queries: Queries, count: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score): the best documents of each item among those with one of the keys (and maybe some more)."""
    keys = stored(keys)
    few = keys.count() <= KEYS
    if few:
        docs = docs.join(F.broadcast(keys), "key", "left_semi")
    bits = None if few else bit_map(keys.select(F.col("key").alias("hash")))
    shared = docs.sparkSession.sparkContext.broadcast((queries, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, wanted = shared.value
        flat = np.concatenate([*q.of, np.zeros(0, np.int64)])
        filled = np.flatnonzero([len(of) for of in q.of])  # items with terms
        starts = np.cumsum([0, *map(len, q.of)])[filled]
        best: list[list[tuple]] = [[] for _ in q.items]
        least = np.ones(len(q.items), np.int64)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), utf8_rows(batch.column("text"))
            kept = range(len(ids)) if wanted is None else np.flatnonzero(held_by(wanted, batch.column("key").to_numpy().view(np.uint64))).tolist()
            for i in kept:
                words = words_of(texts[i])
                held = Counter(words)
                own = list(held.keys() & q.terms.keys())
                if not own:
                    continue
                at = np.array([q.terms[t] for t in own])
                worth = np.zeros(len(q.terms), np.int64)
                worth[at] = q.weights[at] * impact(np.array([held[t] for t in own], np.int64), q.norms([len(words)])[0])
                scores = np.zeros(len(q.items), np.int64)
                scores[filled] = np.add.reduceat(worth[flat], starts)
                order = (ids[i] is None, ids[i] or 0)
                for item in np.flatnonzero(scores >= least).tolist():
                    heap, entry = best[item], (int(scores[item]), (not order[0], -order[1]))
                    if len(heap) < count:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == count:
                        least[item] = heap[0][0]
        rows = [(item, -number if named else None, score) for item, heap in enumerate(best) for score, (named, number) in heap]
        item, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    small_batches(docs.sparkSession)
    found = docs.select("key", "doc_id", "text").mapInArrow(run, "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= count)


def search(docs: DataFrame, items: DataFrame, count: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``count`` best documents (doc_id integer, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    asked = items.select("item_id", "text").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).head()
    parts = max(1, -(-size.b * 4 // QUERY_BYTES), -(-size.n // QUERY_ITEMS))
    index, results = None, []
    for part in range(parts):
        queries = Queries(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect())
        counted = index_documents(rows, queries.terms, slices=index is None)
        index = counted if index is None else index
        queries.weigh(counted)
        least = np.ones(len(queries.items), np.int64)
        for r in exact_scores(rows, seeds(index, queries), queries, count).where(F.col("rank") == count).collect():  # one row for each item of the part
            least[r.item] = r.score
        best = exact_scores(rows, not_excluded(index, queries, least), queries, count)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(queries.items)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        results.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


_FOLDED = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def oracle(count: int = TOP) -> str:
    """DuckDB SQL for ``search`` over ``documents`` and ``benchmark``."""
    return f"""
with words as materialized (select row_number() over () as r, doc_id, {_FOLDED.format(text="text")} as ws from documents),
lengths as materialized (select r, doc_id, cast(len(ws) as bigint) as n from words where len(ws) > 0),
totals as (select cast(count(*) as bigint) as big_n, cast(sum(n) as bigint) as l from lengths),
asked as materialized (select distinct item_id, unnest({_FOLDED.format(text="text")}) as term from benchmark),
held as materialized (select r, term, cast(count(*) as bigint) as tf from (select r, unnest(ws) as term from words) where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from held, totals group by term, big_n),
scores as (select item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // l)))) as bigint) as score
    from asked join held using (term) join weights using (term) join lengths using (r), totals group by all)
select * from (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scores where score > 0) where rank <= {count}"""
