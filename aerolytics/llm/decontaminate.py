"""Benchmark decontamination: a prefix-filtered set join, verified word by word.

A window is ten consecutive words of an item, or the whole of a shorter one; equal windows of any
items are one.  A window is the set of its shingles (five consecutive words; of a window of fewer, all
of it), and it can only occur where all of them do.  Shingles are ordered by the number of documents
that hold them: for exact containment the rarest one is the necessary prefix, and a window with a
shingle that no document holds occurs nowhere.  Documents meet windows on those prefix shingles in a
join.  A document brings the words around the place, so that the window's offset from its prefix, the
bounds of the document and at last every word are checked in the joined row.

Documents are read twice, to count shingles and to emit prefixes.  Both times a bit map of the wanted
shingle hashes, at most ``MAP_BITS`` bits however many items there are, keeps all others from being
emitted; it lets through a few that are not wanted, and the join drops them.  Windows are broadcast
only below a size that is checked; a larger table is joined by (shingle, part of the documents), so
that a shingle that a third of the documents hold spreads over tasks.  Repeated words cost no more
than others: equal windows are one, and equal surroundings within a document are one row.

Edge cases: a null text has no words; a document without words is clean; an item without
words has no window; items of one id count once; repeated rows are judged one by one; a null
item id is written as an empty string.  A text of any length is one row of words.  Other columns
of the input pass through unchanged, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import free_names, map_batches, own_columns, ship, small_batches, stored, utf8_rows
from aerolytics.operators.attach import attach, merge_join

WINDOW, SHINGLE = 10, 5
#: Bits of a bit map by wanted shingle, and the most it may have (32 MB).
BITS_EACH, MAP_BITS = 32, 1 << 28
#: Distinct shingles whose counts a task holds, and parts of a frequent shingle's documents in a join by parts.
HELD, PARTS = 1_000_000, 64

#: Bytes of words as they are, A-Z in lower case, all others a blank.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
# An odd base of a polynomial hash modulo 2^64, its inverse, and an odd factor that spreads the hashes.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE, _SPREAD = pow(_BASE, -1, 1 << 64), 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table))
        _powers[:] = made
    return _powers


class Words:
    """The words of a text as one line, and hashes of its runs of words."""

    def __init__(self, text: bytes):
        self.line = b" ".join(words_of(text))
        data = np.frombuffer(self.line, np.uint8)
        gaps = np.flatnonzero(data == 0x20)
        self.starts = np.concatenate(([0], gaps + 1)) if len(data) else np.zeros(0, np.int64)
        self.ends = np.concatenate((gaps, [len(data)])) if len(data) else self.starts
        self.n = len(self.starts)
        power, self._inverse = _power_tables(len(data))
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))

    def hashes(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        a, b = self.starts[: self.n - size + 1], self.ends[size - 1 :]
        found = (self._sums[b] - self._sums[a]) * self._inverse[a] * np.uint64(_SPREAD)
        return (found ^ (found >> np.uint64(29))) * np.uint64(_SPREAD)

    def run(self, first: int, last: int) -> bytes:
        """The words first .. last-1."""
        return self.line[self.starts[first] : self.ends[last - 1]]


def windows_of(text: bytes, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """The distinct windows of an item: words, their number, and the hashes of the window's shingles in order."""
    words = Words(text)
    size = min(window, words.n)
    if not size:
        return [], [], []
    own = min(shingle, size)
    hashes, places = words.hashes(own), {}
    for at in range(words.n - size + 1):
        places.setdefault(words.run(at, at + size), at)
    return list(places), [size] * len(places), [hashes[at : at + size - own + 1] for at in places.values()]


# ---- bit maps ----


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of the ``hash`` column, as bytes; at most ``MAP_BITS`` of them reach the driver, whatever the table."""
    count = hashes.select(F.approx_count_distinct("hash")).head()[0]
    bits = max(12, min(MAP_BITS.bit_length() - 1, int(max(1, count) * BITS_EACH - 1).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = hashes.groupBy(F.shiftright(place, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << max(bits - 5, 0), "<u4")
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype("<u4")
    return out.view(np.uint8)


def held_by(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bit map may hold."""
    size = int(len(bits) * 8).bit_length() - 1
    place = hashes >> np.uint64(64 - size)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


# ---- windows and their prefixes ----


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, size, hashes) of distinct windows, and (wid, item) of the items that hold them; stored."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, words, sizes, hashes = [], [], [], []
        for item, text in zip(batch.column("item").to_pylist(), utf8_rows(batch.column("text")), strict=True):
            a, b, c = windows_of(text, window, shingle)
            ids += [item] * len(a)
            words, sizes, hashes = words + a, sizes + b, hashes + [x.view(np.int64) for x in c]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "words", "size", "hashes"])

    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cut_up = map_batches(own, cut, "item string, words binary, size int, hashes array<long>").withColumn("wid", F.md5("words"))
    each = stored(cut_up)
    return stored(each.groupBy("wid").agg(F.first("words").alias("words"), F.first("size").alias("size"), F.first("hashes").alias("hashes"))), each.select("wid", "item").distinct()


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(hash, n): how many documents hold each shingle of the bit map; each task adds up its own first."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        n = 0

        def rows() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["hash", "n"])

        for batch in batches:
            for text in utf8_rows(batch.column("text")):
                words = Words(text)
                for size in sizes:
                    hashes = words.hashes(size)
                    hit = hashes[held_by(shared.value, hashes)]
                    if len(hit):
                        parts.append(np.unique(hit))
                        n += len(parts[-1])
                if n > HELD:
                    yield rows()
                    parts, n = [], 0
        yield rows()

    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """(hash, offset, length, wid, words, size): the rarest shingle of each window that may occur, the first among equals."""
    each = merge_join(windows.select("wid", F.size("hashes").alias("parts"), F.posexplode("hashes").alias("offset", "hash")), counts, "hash")
    best = each.groupBy("wid", "parts").agg(F.min(F.struct("n", "hash", "offset")).alias("best"), F.count("*").alias("there")).where("there = parts")
    chosen = best.select("wid", "best.hash", "best.offset").join(windows.select("wid", "words", "size"), "wid")
    return chosen.withColumn("length", F.least(F.col("size"), F.lit(shingle)))


# ---- the join ----

_HITS = "array<struct<hash:bigint,length:int,before:int,around:binary,places:array<int>>>"


def emit_prefixes(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """The rows of (key, text and others) with ``n_words`` and ``hits``, text left out: places of prefix shingles and the words around them.

    Surroundings reach as far as a window can on both sides; those of a shingle that is a whole window hold it alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = [c for c in docs.columns if c != "text"]

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found = [], []
        for text in utf8_rows(batch.column("text")):
            words, rows = Words(text), {}
            for size in sizes:
                hashes = words.hashes(size)
                reach = window - size if size == shingle else 0
                for p in np.flatnonzero(held_by(shared.value, hashes)).tolist():
                    low = max(0, p - reach)
                    key = int(hashes[p]), size, p - low, words.run(low, min(words.n, p + size + reach))
                    rows.setdefault(key, []).append(p)
            counts.append(words.n)
            found.append([{"hash": h - (1 << 64) if h >> 63 else h, "length": s, "before": b, "around": a, "places": at} for (h, s, b, a), at in rows.items()])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("before", pa.int32()), ("around", pa.binary()), ("places", pa.list_(pa.int32()))]))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(counts, pa.int64()), pa.array(found, kind)], [*names, "n_words", "hits"])

    kinds = dict(docs.dtypes)
    return map_batches(docs, search, ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_words long", f"hits {_HITS}"]))


def verified(hits: DataFrame, prefix: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, wid, start, size) of windows that do occur in the texts of (key, hits)."""
    rows = hits.select("key", F.explode("hits").alias("h")).select("key", "h.*").withColumn("_place", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    met = attach(rows, prefix, ["hash", "length"], order="_place", limit=limit, rows=1)
    text = F.split(F.decode("around", "UTF-8"), " ")
    first = F.col("before") - F.col("offset")  # of the window, in the words around
    inside = (first >= 0) & (first + F.col("size") <= F.size(text))
    same = F.when(inside, F.array_join(F.slice(text, F.greatest(first, F.lit(0)) + 1, F.col("size")), " ") == F.decode("words", "UTF-8"))
    return met.where(same).select("key", "wid", F.explode("places").alias("p"), "offset", "size").select("key", "wid", (F.col("p") - F.col("offset")).alias("start"), "size").distinct()


def text_key(text: Column) -> Column:
    """What a verdict depends on: equal texts have equal verdicts."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _search(docs: DataFrame, items: DataFrame, window: int, shingle: int, limit: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the rows of ``docs`` without text but with n_words and hits, stored), their verified windows, and (wid, item)."""
    windows, holders = item_windows(items, window, shingle)
    all_hashes = windows.select(F.explode("hashes").alias("hash"))
    sizes = sorted(min(r.size, shingle) for r in windows.select("size").distinct().collect())  # at most ``window`` rows
    sizes = sorted(set(sizes))
    counts = shingle_counts(docs, bit_map(all_hashes), sizes)
    prefix = stored(prefixes(windows, counts, shingle))
    rows = stored(emit_prefixes(docs, bit_map(prefix), sizes, window, shingle))
    return rows, verified(rows, prefix, limit), holders


def judge_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, limit: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, hits, holders = _search(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), items, window, shingle, limit)
    hits = stored(hits)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")), lambda a: a["n"],
    )
    words = hits.groupBy("key").agg(merged.alias("n_hit"))
    ids = hits.select("key", "wid").distinct().join(holders, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    verdicts = words.join(ids, "key")
    plain = rows.select("doc_id", "key", "n_words").withColumn("_place", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    found = attach(plain, verdicts, ["key"], order="_place", how="left", limit=limit, rows=1)
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    _, hits, _ = _search(docs.select(text_key(F.col("text")).alias("key"), "text"), items, window, shingle, None)
    (key,) = free_names(docs, "_key")
    wrong = stored(hits.select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, text_key(F.col("text"))).join(wrong, key, "left_anti").select(*own_columns(docs))


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the same rows: all runs of words of all documents, joined to all windows."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as w from documents),
i as (select distinct coalesce(cast(item_id as varchar), '') as item, {words} as w from benchmark),
v as (select item, w, least(len(w), {window}) as size from i where len(w) > 0),
u as (select distinct item, size, array_to_string(w[a + 1 : a + size], ' ') as win from (select *, unnest(range(0, len(w) - size + 1)) as a from v) x),
p as (select r, size, p, array_to_string(w[p + 1 : p + size], ' ') as win from (select d.r, d.w, s.size, unnest(range(0, len(d.w) - s.size + 1)) as p from d, (select distinct size from u) s where len(d.w) >= s.size) x),
m as (select p.r, p.p, p.size, u.item from p join u on u.size = p.size and u.win = p.win),
h as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + size)) as q from m) x group by 1),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from m) x group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join h on h.r = d.r left join t on t.r = d.r"""
