"""Near copies by SimHash and Jaccard similarity of five-word shingles, for the pipeline.

A part of operator 8.  Texts are lower-cased words (as in ``simhash``); a document's set holds the XXH64 of
its runs of five words.  Two searches propose pairs, and every pair is verified on the two whole sets before it
links (Jaccard 0.8 or more): the covering tables of ``simhash`` over 64-bit fingerprints of the same shingles,
which miss no pair within ``RADIUS`` bits, and MinHash bands for pairs further apart.  Fingerprints of texts
with a similarity of 0.8 differ in about ten bits of 64; a radius that covers them would need some 2^17 tables,
so the bands do the larger part: at a similarity of exactly 0.8, 30 bands of 5 rows miss 7 of a million pairs.

Equal word sequences are one node from the start.  Of each bucket the nodes are first compared to a few leaders, which
is linear and connects most of what is alike: a node meets the leader that most of its bands name, and others only where it is not connected yet.  A bucket whose nodes are one component then is done: no pair of it can join
anything.  In every other one all pairs of nodes of different components are compared, whatever the bucket's size: in a small one as
rows, in a large one by blocks of nodes, each with its sets in one task, so that no row stands for a pair and a set is moved once for a
block.  So components are those of all pairs that share a band or a near fingerprint; the comparisons of a bucket are its size times
the number of its nodes outside its largest component, and grow with the square of its size only where its texts are unlike.

Edge cases: null and empty texts, and texts without words, are one node; a text of fewer words
than a shingle is one shingle.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.operators.attach import BROADCAST_BYTES, attach, merge_join

from aerolytics.llm.common import map_batches, ship, small_batches, stored, utf8_rows
from aerolytics.llm.components import component_labels
from aerolytics.llm.decontaminate import bit_map, held_by
from aerolytics.llm.simhash import RADIUS, fingerprint, near_edges
from aerolytics.llm.survivors import dealt, decided, survivors, text_hash

SHINGLE, BANDS, ROWS, SEED = 5, 30, 5, 42
#: Similarity from which on two documents are near copies, as a fraction.
SIMILAR = (4, 5)
#: Nodes that a task remembers so as not to give their texts again.
REMEMBERED = 300_000
#: Nodes of a bucket whose pairs are rows, a larger one is compared by blocks; leaders of a bucket beside the smallest of all.
BUCKET, LEADERS = 32, 2
#: Nodes of a block: those outside a bucket's largest component, and any that they are compared to.
OUTER_BLOCK, BLOCK = 128, 512
_dice = random.Random(SEED)
FACTORS = np.array([_dice.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)
TERMS = np.array([_dice.getrandbits(64) for _ in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; none where there is no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((hashed(line[s:e], SEED) for s, e in pairs), np.uint64, len(words) - shingle + 1))


def node(text: bytes) -> int:
    """A text's words as a number."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED + 1)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, int]:
    """A key for each band of the MinHash signature of a set, and the set's size."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1_024):  # a very long text in bounded steps
        least = np.minimum(least, (found[at : at + 1_024] * FACTORS[:, None] + TERMS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(-1, ROWS))], np.uint64), len(found)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64)))


def rows_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a table by ``node`` whose node is wanted; the others aren't moved where the wanted ones fit a broadcast."""
    return dealt(table, stored(wanted.distinct()), ["node"], "node", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    part, whole = SIMILAR
    a, b = (rows_of(sets, pairs.select(F.col(n).alias("node"))).select(F.col("node").alias(n), F.col("own").alias(f"of_{n}")) for n in "uv")
    both, sizes = F.size(F.array_intersect("of_u", "of_v")), F.size("of_u") + F.size("of_v")
    close = whole * F.least(F.size("of_u"), F.size("of_v")) >= part * F.greatest(F.size("of_u"), F.size("of_v"))
    return merge_join(merge_join(pairs, a, "u"), b, "v").where(close).where(both * (whole + part) >= sizes * part).select("u", "v")


def verified_stars(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): what connects the same nodes as the pairs of leaders and nodes with similar sets do; a node's set is moved once, not once for each leader.

    Of the proposed pairs (u, v, c) each node first meets the leader that most of its bands name; what that connects is left out, and only nodes that
    are in another component than a further leader of theirs meet that one, too.
    """
    first = stored(stars.groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u")))
    links = stored(star_links(first, sets))
    labels = component_labels(links)
    rest = merge_join(stars.select("u", "v"), first, ["u", "v"], "left_anti")
    for side in "uv":
        rest = dealt(rest, labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), [side], "u" if side == "v" else "v", "left")
    apart = stored(rest.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v"))
    return links.unionByName(star_links(apart, sets))


def star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """The links of ``verified_stars``, every pair compared."""
    part, whole = SIMILAR
    led = dealt(sets.select(F.col("node").alias("v"), F.col("own").alias("of_v")), stored(stars.groupBy("v").agg(F.collect_set("u").alias("us"))), ["v"], "v")
    leaders, fits = small(rows_of(sets, stars.select(F.col("u").alias("node"))).select(F.col("node").alias("u"), F.col("own").alias("of_u"), F.size("own").alias("n_u")))
    rows = led.select("v", "of_v", F.explode("us").alias("u"))
    met = (rows.join(F.broadcast(leaders), "u") if fits else merge_join(rows, leaders, "u")).withColumn("n_v", F.size("of_v")).where(whole * F.least("n_u", "n_v") >= part * F.greatest("n_u", "n_v"))
    links = met.where(F.size(F.array_intersect("of_u", "of_v")) * (whole + part) >= (F.col("n_u") + F.col("n_v")) * part).select("u", "v")
    # A node that several leaders hold connects them: it keeps one of them, and so does each of the others.
    own = links.groupBy("v").agg(F.collect_set("u").alias("us")).withColumn("first", F.array_min("us"))
    return own.select(F.col("first").alias("u"), F.explode(F.concat(F.array("v"), "us")).alias("v")).where("u <> v").distinct()


def small(sets: DataFrame) -> tuple[DataFrame, bool]:
    """The sets, stored, and whether their bytes fit a broadcast."""
    kept = stored(sets)
    return kept, (kept.agg(F.sum(F.col("n_u") * 8 + 64)).head()[0] or 0) <= BROADCAST_BYTES


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, node, size) of the keys that several nodes share, stored."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(merge_join(keyed, sizes, "key"))


def star_pairs(crowded: DataFrame) -> DataFrame:
    """(u, v), once for each key: leaders of its nodes, found by partial minima, and the nodes whose sets have sizes of similar ones."""
    part, whole = SIMILAR
    ranks = [F.xxhash64("node"), *[F.xxhash64("node", "key", F.lit(i)) for i in range(LEADERS)]]
    leaders = crowded.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(F.struct("node", "n"), r) for r in ranks])).alias("leaders"))
    led = attach(crowded.withColumn("_place", F.pmod(F.xxhash64("node"), F.lit(64))), leaders, ["key"], order="_place", rows=1)
    met = led.select(F.explode("leaders").alias("at"), F.col("node").alias("v"), "n").where("at.node <> v").where(whole * F.least("n", "at.n") >= part * F.greatest("n", "at.n"))
    return met.select(F.col("at.node").alias("u"), "v")


def texts_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, text) of the nodes that the bit map may hold; a task gives a node it still remembers only once, so that copies don't pile up."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.array([node(x) for x in utf8_rows(batch.column("text"))], np.uint64)
            own = nodes.tolist()
            at = [i for i in np.flatnonzero(held_by(shared.value, nodes)).tolist() if not (own[i] in seen or seen.add(own[i]))]
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at].view(np.int64)), batch.column("text").take(pa.array(at, pa.int64()))], ["node", "text"])

    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(pick, "node long, text string")


def mixed_keys(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, n, size, label, outer, outers) of the keys whose nodes have several labels, stored.

    ``outer`` tells the nodes outside the key's largest component, ``outers`` is their number; keys of one component, and their rows, are left out.
    """
    known = dealt(held, labels, ["node"], "key", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("key", "label").agg(F.count("*").alias("m"))
    mains = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max_by("label", F.struct("m", "label")).alias("main"), (F.sum("m") - F.max("m")).alias("outers")).where("classes > 1").drop("classes")
    return stored(merge_join(known, mains, "key").withColumn("outer", F.col("label") != F.col("main")).drop("main"))


def unlike_pairs(mixed: DataFrame) -> DataFrame:
    """(u, v), u below v: all pairs of nodes of a small key that have different labels and sizes ``n`` of similar sets."""
    part, whole = SIMILAR
    rows = mixed.where(F.col("size") <= BUCKET)
    u, v = (rows.select("key", F.col("node").alias(x), F.col("label").alias(f"of_{x}"), F.col("n").alias(f"n_{x}"), F.col("outer").alias(f"outer_{x}")) for x in "uv")
    met = merge_join(u.where("outer_u"), v, "key").where("of_u <> of_v and (not outer_v or u < v)").where(whole * F.least("n_u", "n_v") >= part * F.greatest("n_u", "n_v"))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def block_links(mixed: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): what connects the nodes that the similar pairs of large keys, of different labels, connect.

    The nodes outside a key's largest component are dealt to blocks, and all of its nodes to others; each pair of blocks meets in one
    group of bounded size.  A pair is compared in the first band that it shares only, if that is a small key as a row (see ``unlike_pairs``).
    """
    number = lambda n, most: F.ceil(F.col(n) / most)
    own = lambda side, of: F.pmod(F.xxhash64("node", F.lit(side)), of)
    first, second = number("outers", OUTER_BLOCK), number("size", BLOCK)
    every = lambda of, fn: F.transform(F.sequence(F.lit(0).cast("long"), of - 1), fn)
    place = lambda left, a, b: F.struct(F.lit(left).alias("left"), a.alias("a"), b.alias("b"))
    left, right = every(second, lambda b: place(True, own(0, first), b)), every(first, lambda a: place(False, a, own(1, second)))
    places = F.explode(F.when(F.col("outer"), F.concat(left, right)).otherwise(right)).alias("at")
    large = mixed.where(F.col("size") > BUCKET)
    wanted = large.select("node").distinct()
    held = merge_join(large, merge_join(rows_of(nodes.select("node", "keys"), wanted), rows_of(sets, wanted), "node"), "node")
    spread = held.select("key", "node", "label", "outer", "keys", "own", places).select("key", "at.*", "node", "label", "outer", "keys", "own")
    return spread.groupBy("key", "a", "b").applyInArrow(compare_block, "u long, v long").distinct()


def compare_block(block: pa.Table) -> pa.Table:
    """Links (u, v) that connect what the similar pairs of a left and a right row with different labels connect."""
    left, node, label, outer = (block.column(c).to_numpy() for c in ("left", "node", "label", "outer"))
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    found: list[tuple[int, int]] = []
    if len(a) and len(b):
        part, whole = SIMILAR
        keys, own = (block.column(c).combine_chunks() for c in ("keys", "own"))
        bands = keys.flatten().to_numpy().reshape(-1, BANDS)
        band = int(np.flatnonzero(bands[a[0]] == block.column("key")[0].as_py())[0])
        _, at = np.unique(own.flatten().to_numpy(), return_inverse=True)  # a block's own numbers for the hashes
        ends = np.cumsum([0, *own.value_lengths().to_numpy()])
        sizes, flags = np.diff(ends), np.zeros(len(at), bool)
        theirs = np.concatenate([at[ends[j] : ends[j + 1]] for j in b])
        cuts = np.concatenate(([0], np.cumsum(sizes[b])))
        root = dict(zip(node.tolist(), node.tolist(), strict=True)) if len(node) else {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in a:
            shares = (bands[b] == bands[i]).argmax(axis=1) == band
            close = whole * np.minimum(sizes[b], sizes[i]) >= part * np.maximum(sizes[b], sizes[i])
            fits = shares & close & (label[b] != label[i]) & (~outer[b] | (node[i] < node[b]))
            if not fits.any():
                continue
            mine = at[ends[i] : ends[i + 1]]
            flags[mine] = True
            both = np.diff(np.concatenate(([0], np.cumsum(flags[theirs])))[cuts])
            flags[mine] = False
            for j in b[fits & (both * (whole + part) >= (sizes[b] + sizes[i]) * part)]:
                u, v = int(node[i]), int(node[j])
                if find(u) != find(v):
                    root[find(u)] = find(v)
                    found.append((min(u, v), max(u, v)))
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def link_near_copies(docs: DataFrame, radius: int = RADIUS, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) of every row, ``th`` being the hash of its text, and (node, label) of the nodes that have near copies: the smallest node of the component.

    ``exact`` is kept for callers: no bucket is compared in part any more.
    """

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8_rows(batch.column("text"))
        nodes = np.array([node(x) for x in texts], np.uint64).view(np.int64)
        prints = np.array([fingerprint(x, SHINGLE, SEED) for x in texts], np.uint64).view(np.int64)
        keys = [band_keys(shingles(x)) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(nodes), pa.array(prints), _lists([k for k, _ in keys]), pa.array([n for _, n in keys], pa.int64())], ["doc_id", "th", "node", "fp", "keys", "n"])

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), _lists([shingles(x) for x in utf8_rows(batch.column("text"))])], ["node", "own"])

    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    signed = stored(map_batches(keyed, sign, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, node long, fp long, keys array<long>, n long"))
    nodes = stored(signed.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n")))

    # Nodes of one fingerprint propose themselves to its smallest, and those to what the covering tables connect them with.
    points = stored(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("size")))
    equal = merge_join(nodes, points.where("size > 1"), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = near_edges(points.select("fp"), radius)
    for side in ("u", "v"):
        near = merge_join(near, points.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}")), side)
    close = stored(equal.unionByName(near.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))))

    held = shared_keys(nodes.select("node", "n", F.explode("keys").alias("key")))
    pairs = stored(star_pairs(held.select("key", "node", "n")).unionByName(close).groupBy("u", "v").agg(F.count("*").alias("c")))
    wanted = stored(held.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct())
    texts = merge_join(texts_of(docs, bit_map(wanted.select(F.col("node").alias("hash")))), wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(map_batches(texts, collect, "node long, own array<long>"))
    labels = component_labels(verified_stars(pairs, sets))

    told = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    mixed = mixed_keys(held, labels)
    more = stored(verified(stored(merge_join(unlike_pairs(mixed), told, ["u", "v"], "left_anti")), sets).unionByName(block_links(mixed, nodes, sets)))
    # What the rest of the pairs connects are components: a pair is a link of two of them, and a node that had none is one.
    alone = merge_join(more.select(F.explode(F.array("u", "v")).alias("node")).distinct(), labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    known = stored(labels.unionByName(alone))
    for side in "uv":
        more = dealt(more, known.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), [side], "u" if side == "v" else "v")
    joined = component_labels(more.select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
    final = dealt(known, joined.select(F.col("node").alias("label"), F.col("label").alias("_then")), ["label"], "node", "left")
    return signed.select("doc_id", "th", "node"), stored(final.select("node", F.coalesce("_then", "label").alias("label")))


def keep_one_of_each(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row of each component of near copies (see ``survivors``), with its own columns; texts unlike all others stay, whatever their ids."""
    return survivors(docs, decided(*link_near_copies(docs, exact=exact)))
