"""Centroid clustering (integer k-means) in JVM expressions only.

A component x becomes the integer floor(scale * x).  Each round holds the centroids as literal arrays: ``zip_with``
and ``aggregate`` give a vector's squared distances, ``array_min`` of (distance, number) structs its cluster, and one
aggregate of component sums - a column each, partial sums first - the next centroids.  The driver sees k rows of sums
a round, whatever the number of vectors; the integers are stored once and read again by each round, so that a lost
executor costs some tasks of one round.  A cluster that holds a third of all vectors is still k partial rows a task.

Edge cases: vectors of another length, null vectors and vectors with a null, NaN or infinite component are left out;
a component of ``LIMIT`` or more, whose distances might not fit 64 bits, is an error.  Rows without ``vec_id`` are
clustered but never start a centroid; rows that repeat an id are vectors of their own, ties of the start order
go by the components.  With fewer than k vectors there are as many clusters; an empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import stored

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Bound of an integer component: 4 * LIMIT^2 * DIMS stays below 2^63 up to 2^9 components.
LIMIT = 1 << 26
SCHEMA = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors with exactly ``dims`` finite components, as integers."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == math.inf))
    kept = vectors.where(F.coalesce((F.size(x) == dims) & ~odd, F.lit(False)))
    scaled = F.transform(x, lambda v: v.cast("double") * scale)
    large = F.exists(scaled, lambda v: F.abs(v) >= LIMIT)
    return kept.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component of {LIMIT / scale:g} or more"))).otherwise(F.transform(scaled, lambda v: F.floor(v))).alias("q"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in its order."""
    named = kept.where("vec_id is not null").withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r.q) for r in named.orderBy("_hash", "q").select("q").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid of ``q``, the smaller number among equals."""
    literal = F.expr("array(" + ",".join("array(" + ",".join(f"{int(v)}L" for v in c) + ")" for c in centroids) + ")")
    square = lambda a, b: (a - b) * (a - b)
    away = lambda c: F.aggregate(F.zip_with("q", c, square), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return F.array_min(F.transform(literal, lambda c, j: F.struct(away(c).alias("distance"), j.cast("int").alias("cluster"))))


def moved_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: each centroid becomes the floor of its vectors' mean; one without vectors stays."""
    near = kept.select("q", nearest(centroids).alias("near"))
    sums = near.groupBy(F.col("near.cluster").alias("cluster")).agg(F.count("*").alias("n"), *[F.sum(F.col("q")[d]).alias(f"s{d}") for d in range(len(centroids[0]))])
    out = [list(c) for c in centroids]
    for row in sums.collect():  # at most k rows
        out[row.cluster] = [s // row.n for s in row[2:]]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each whole vector, and the final centroids."""
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, dims, scale))
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, {SCHEMA}"), []
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids)
    assigned = stored(kept.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"))
    own = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    inertias = F.expr("array(" + ",".join(f"{own.get(c, 0)}L" for c in range(len(centroids))) + ")")
    digests = F.array(*[F.lit(digest(c)) for c in centroids])
    at = lambda values: F.element_at(values, F.col("cluster") + 1)
    return assigned.select("vec_id", "cluster", "distance", at(inertias).alias("cluster_inertia"), F.lit(sum(own.values())).cast("bigint").alias("inertia"), at(digests).alias("centroid_sha256")), centroids


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for ``cluster_vectors`` over ``embeddings``."""
    finite = "len(list_filter(embedding, lambda v: v is not null and isfinite(v)))"
    parts = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda v: cast(floor(cast(v as double) * {scale}) as bigint)) as q from embeddings where len(embedding) = {dims} and {finite} = {dims})",
        "x as materialized (select r, unnest(q) as v, generate_subscripts(q, 1) as d from kept)",
        f"c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)), q) - 1 as int) as k, q from kept where vec_id is not null order by k limit {k})",
        "m0 as materialized (select k, unnest(q) as v, generate_subscripts(q, 1) as d from c0)",
    ]
    near = lambda i: f"n{i} as materialized (select r, min(struct_pack(dist := dist, k := k)) as m from (select r, k, sum((x.v - c.v) * (x.v - c.v)) as dist from x join m{i} c using (d) group by r, k) group by r)"
    for i in range(rounds):
        new = "select m.k as k, d, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as v"
        parts += [near(i), f"m{i + 1} as materialized (select o.k, o.d, coalesce(f.v, o.v) as v from m{i} o left join ({new} from n{i} join x using (r) group by 1, 2) f on f.k = o.k and f.d = o.d)"]
    parts += [near(rounds), f"s as (select k, sha256(string_agg(cast(v as varchar), ',' order by d)) as digest from m{rounds} group by k)"]
    return "with " + ",\n".join(parts) + f"""
select vec_id, m.k as cluster, cast(m.dist as bigint) as distance, cast(sum(m.dist) over (partition by m.k) as bigint) as cluster_inertia,
    cast(sum(m.dist) over () as bigint) as inertia, digest as centroid_sha256
from n{rounds} join kept using (r) join s on s.k = m.k"""
