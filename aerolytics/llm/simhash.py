"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints of 64 bits are majority votes over the XXH64 of word shingles.  For radius r,
bit i gets a vector m(i) of r+1 bits; each non-zero vector v of r+1 bits makes a mask of the
bits i with an odd <m(i), v>.  At most r differing bits span at most r dimensions, so some v
is orthogonal to all of their vectors: under its mask the two fingerprints are equal.  Hence
all pairs within the radius - none is missed - collide in one of the 2^(r+1)-1 tables.

Distinct fingerprints stand for their documents throughout.  A bucket of up to
``BUCKET`` fingerprints is compared in full within one row and gives a star per local
component, never all pairs.  A larger bucket is dealt out by midpoints: fingerprints
within r of each other share a point within r/2 of both, and each such point (a key of its
own) gives one star; its rows are linear in the bucket's size.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and link like
any other; a text of fewer words than a shingle is one shingle; rows without doc_id take part,
and a component of such rows alone has a null id; repeated rows link to themselves at once.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolytics.llm.common import map_batches, stored, utf8_rows
from aerolytics.llm.components import component_labels
from aerolytics.llm.survivors import dealt, decided, survivors, text_hash
from aerolytics.operators.attach import merge_join

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Fingerprints of a bucket that are compared at once.
BUCKET = 1_500


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set where over half the shingles' hashes have it."""
    words = text.lower().split()  # on bytes: A-Z only, and the blanks 0x20, 0x09-0x0D only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    votes, n = np.zeros(BITS, np.int64), 0
    for at in range(0, last, 65_536):  # a very long text in bounded steps
        a, b = starts[at : min(at + 65_536, last)].tolist(), ends[at + shingle - 1 : min(at + 65_536, last) + shingle - 1].tolist()
        found = np.array([hashed(line[s:e], seed) for s, e in zip(a, b, strict=True)], "<u8")
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(found)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle, seed) for x in utf8_rows(batch.column("text"))], "<u8")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1)-1 masks as signed numbers; bit vectors are dealt evenly, then shuffled by a fixed seed."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    random.Random(bits * radius).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def star_edges(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(point, smallest point of its component) among the given distinct points, under links of at most ``radius`` bits."""
    points = np.sort(points)
    bits = points.view(np.uint64)  # of a negative number, bitwise_count takes the absolute value
    free, edges = np.ones(len(points), bool), []
    for i in range(len(points)):
        if not free[i]:
            continue
        free[i], front = False, [i]
        while front:
            near = np.flatnonzero(free & (np.bitwise_count(bits ^ bits[front.pop()]) <= radius))
            free[near] = False
            front += near.tolist()
            edges += [(int(points[j]), int(points[i])) for j in near]
    return edges


def near_edges(points: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) stars that connect what pairs of distinct ``fp`` within the radius connect."""
    masks = covering_masks(radius)
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"))
    sized = keyed.groupBy("mask", "key").agg(F.count("*").alias("size"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("size > 1")
    pairs = sized.where("size = 2").where(F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius).select(F.col("low").alias("u"), F.col("high").alias("v"))
    more = sized.where("size > 2").select("mask", "key", "size")
    held = merge_join(keyed, more, ["mask", "key"])

    small = held.where(F.col("size") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("fps")
        cuts, flat = column.offsets.to_numpy(), column.values.to_numpy()
        edges = [e for s, t in zip(cuts[:-1], cuts[1:], strict=True) for e in star_edges(flat[s:t], radius)]
        edges = list(dict.fromkeys(edges))
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])

    stars = map_batches(small, compare, "u long, v long")

    # Midpoints differ from a fingerprint in up to half the radius of bits, none of them under the mask.
    signed = [(1 << i) - ((1 << BITS) if i == BITS - 1 else 0) for i in range(BITS)]
    flips = [0, *(x for n in range(1, radius // 2 + 1) for x in map(_xor, combinations(signed, n)))]
    free = F.element_at(F.array(*[F.lit(~m).cast("long") for m in masks]), F.col("mask") + 1)
    inside = F.filter(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: x.bitwiseAND(F.col("free")) == x)
    middle = held.where(F.col("size") > bucket).withColumn("free", free).select("mask", "key", "fp", F.explode(inside).alias("flip"))
    group = Window.partitionBy("mask", "key", F.col("fp").bitwiseXOR(F.col("flip")))
    middles = middle.select(F.col("fp").alias("u"), F.min("fp").over(group).alias("v")).where("u <> v")
    return pairs.unionByName(stars).unionByName(middles).distinct()


def _xor(numbers: tuple[int, ...]) -> int:
    out = 0
    for x in numbers:
        out ^= x
    return out


def print_groups(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, label, component_id) of each distinct fingerprint of (doc_id, fp): its component and the smallest doc_id of that; stored."""
    if radius % 2:
        raise ValueError("buckets of any size are handled for an even radius only")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = component_labels(near_edges(points, radius, bucket))
    linked = merge_join(points, labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    roots = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    return stored(merge_join(linked.select("fp", "label"), roots, "label").select("fp", "label", "component_id"))


def link_documents(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): the component's smallest doc_id, the document's own included."""
    prints = stored(fingerprints(docs, shingle))
    found = print_groups(prints, radius, bucket).select("fp", "component_id")
    return dealt(prints, found, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of fingerprints (see ``survivors``), with its own columns; other texts stay, whatever their ids."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle) for x in utf8_rows(batch.column("text"))], "<u8")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found.view("<i8"))], ["doc_id", "th", "node"])

    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    rows = stored(map_batches(keyed, sign, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, node long"))
    groups = print_groups(rows.select("doc_id", F.col("node").alias("fp")), radius).select(F.col("fp").alias("node"), "label")
    return survivors(docs, decided(rows, groups))
