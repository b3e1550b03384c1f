"""Merkle fixity audit of WARC replicas.

Records are hashed, their digests are folded by ordered offset range of each archive file,
ranges by sixteens up to the file, and files by hash bucket up to one root.  Two replicas'
trees are compared from the root; at each level only the children of mismatching nodes are
read, and the records of mismatching ranges name the damage.

A node gathers at most the records of one offset range, sixteen children, or the files of one
bucket, so one huge archive spreads over many tasks.

Edge cases: null urls and bodies are written as empty; repeated pages are records of their own;
pages without id have archives of their own; a record larger than a range belongs to the range that it begins in;
other columns are ignored; empty replicas have equal (absent) roots; records are
matched by archive and offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolytics.llm.common import shared_dir, stored
from aerolytics.operators.attach import attach

PAGES_PER_ARCHIVE = 512
#: Records of one group of pages that share an archive; more are dealt to several.
ARCHIVE_RECORDS, PARTS = 4_096, 1 << 20
RANGE_BYTES, FANOUT, RANGE_LEVELS = 64 << 10, 16, 3
BUCKETS, BUCKET_LEVELS = 16**3, 3
#: Mismatching parents whose children are named in the filter of the next read, which then skips all other row groups.
NAMED = 1_000

RECORD = "concat('WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ', coalesce(url, ''), '\r\nContent-Length: ', cast({bytes} as string), '\r\n\r\n', {body}, '\r\n\r\n')"


def _record(body: str = "coalesce(html, '')") -> Column:
    """A page as a WARC record, with its own length or that of its undamaged body."""
    return F.expr(RECORD.format(bytes="octet_length(coalesce(html, ''))", body=body))


def warc_records(pages: DataFrame, *more: Column) -> DataFrame:
    """Response records of the pages, laid out in archives: archive, offset, length, digest, page_id, url, and what ``more`` says of a page.

    An archive holds ``PAGES_PER_ARCHIVE`` page numbers.  Where these have more than ``ARCHIVE_RECORDS`` records
    (repeated pages, pages without a number), they are dealt to as many archives as that takes, by digest.
    """
    record = _record()
    group = F.coalesce(F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).cast("long"), F.lit(-1).cast("long"))
    hashed = stored(pages.select("page_id", "url", group.alias("_group"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"), *more))
    parts = hashed.groupBy("_group").agg(F.ceil(F.count("*") / ARCHIVE_RECORDS).cast("long").alias("_parts"))
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    placed = attach(hashed.withColumn("_order", number % 64), parts, ["_group"], order="_order", rows=1)
    dealt = placed.withColumn("archive", F.col("_group") * PARTS + number % F.col("_parts")).drop("_order", "_group", "_parts")
    before = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def damaged_replicas(pages: DataFrame, every: int = 61) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages' archives under a fault model: in one record of ``every``, by the url's md5,
    the second replica's body is changed in its middle, cut to a half or gone, or the first replica's record is gone."""
    fault = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 6), 16, 10).cast("long") % every
    half = "cast(floor(length(coalesce(html, '')) / 2) as int)"
    changed = _record(f"concat(substring(coalesce(html, ''), 1, {half}), '~', substring(coalesce(html, ''), {half} + 2))")
    cut = _record(f"substring(coalesce(html, ''), 1, {half})")
    other = F.when(fault == 0, F.sha2(changed.cast("binary"), 256)).when(fault == 1, F.sha2(cut.cast("binary"), 256))
    records = stored(warc_records(pages, fault.alias("fault"), other.alias("other"), F.when(fault == 1, F.octet_length(cut).cast("long")).alias("other_length")))
    first = records.where("fault <> 3").select("archive", "offset", "length", "digest", "page_id")
    second = records.where("fault <> 2").select("archive", "offset", F.coalesce("other_length", "length").alias("length"), F.coalesce("other", "digest").alias("digest"), "page_id")
    return first, second


def _folded(nodes: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """One node above: the digest of its children's digests in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    text = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["digest"])), ",")
    return nodes.groupBy(*keys).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def merkle_tree(records: DataFrame) -> DataFrame:
    """All nodes (level, archive, node, parent, digest), stored by level.

    ``up_archive`` and ``up`` name the node above.  Levels 0 to ``RANGE_LEVELS`` are offset ranges of an archive (64 KiB, then sixteen times more
    each), then come the archive itself, the buckets of archives, and at last the root.
    """
    spark = records.sparkSession
    no_archive = F.lit(None).cast("long")
    base = records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long"))
    node = stored(_folded(base, ["archive", "node"], ["offset", "length"]))
    levels = [node]
    for _ in range(RANGE_LEVELS):
        node = _folded(node.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")), ["archive", "up"], ["node"]).withColumnRenamed("up", "node")
        levels.append(node)
    files = _folded(node, ["archive"], ["node"])
    levels.append(files.withColumn("node", F.pmod(F.xxhash64("archive"), F.lit(BUCKETS))))
    node = _folded(levels[-1], ["node"], ["archive"])
    levels.append(node.withColumn("archive", no_archive))
    for _ in range(BUCKET_LEVELS):
        node = _folded(node.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")), ["up"], ["node"]).withColumnRenamed("up", "node")
        levels.append(node.withColumn("archive", no_archive))
    path = shared_dir(spark)
    # Filed by parent: children of one node lie together, so that a level's read skips the row groups of all others.
    every = reduce(DataFrame.unionByName, [_parents(x, i).select(F.lit(i).alias("level"), "archive", "node", "digest", "up_archive", "up") for i, x in enumerate(levels)])
    every.repartitionByRange("level", "up_archive", "up").sortWithinPartitions("level", "up_archive", "up").write.partitionBy("level").parquet(path)
    return spark.read.schema("archive long, node long, digest string, up_archive long, up long, level int").parquet(path)


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with the key of the node above."""
    if level < RANGE_LEVELS:
        return nodes.withColumns({"up_archive": F.col("archive"), "up": F.floor(F.col("node") / FANOUT).cast("long")})
    if level == RANGE_LEVELS:  # above is the archive; its own number of bucket follows from it
        return nodes.withColumns({"up_archive": F.col("archive"), "up": F.pmod(F.xxhash64("archive"), F.lit(BUCKETS))})
    above = F.col("node") if level == RANGE_LEVELS + 1 else F.floor(F.col("node") / FANOUT).cast("long")
    return nodes.withColumns({"up_archive": F.lit(None).cast("long"), "up": above})


def _children(tree: DataFrame, level: int, wrong: DataFrame | None, named: list | None) -> DataFrame:
    """The nodes of a level below the mismatching ones; of the top level all, which is the root."""
    nodes = tree.where(F.col("level") == level).drop("level")
    if wrong is None:
        return nodes
    if named is not None:  # few: their numbers go into the filter of the scan
        nodes = nodes.where(F.col("up").isin([r.node for r in named]))
    above = wrong.select(F.col("archive").alias("w_archive"), F.col("node").alias("w"))
    return nodes.join(above, F.col("up_archive").eqNullSafe(F.col("w_archive")) & (F.col("up") == F.col("w")), "left_semi")


def mismatching_ranges(first: DataFrame, second: DataFrame) -> DataFrame:
    """(archive, node) of the offset ranges that differ; equal branches are never descended, and equal roots end the search."""
    top = RANGE_LEVELS + 2 + BUCKET_LEVELS
    wrong: DataFrame | None = None
    named: list | None = None
    for level in range(top, -1, -1):
        sides = [_children(x, level, wrong, named) for x in (first, second)]
        a, b = sides[0].select("archive", "node", "digest"), sides[1].select(F.col("archive").alias("b_archive"), F.col("node").alias("b_node"), F.col("digest").alias("b_digest"))
        both = a.join(b, F.col("archive").eqNullSafe(F.col("b_archive")) & (F.col("node") == F.col("b_node")), "full_outer")
        differs = both.where(~F.col("digest").eqNullSafe(F.col("b_digest"))).select(F.coalesce("archive", "b_archive").alias("archive"), F.coalesce("node", "b_node").alias("node"))
        wrong = stored(differs)  # the next level reads it twice
        few = wrong.select("node").distinct().limit(NAMED + 1).collect() if level else []
        named = few if len(few) <= NAMED else None
        if level and not few:
            return wrong
    return wrong


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per damaged record: archive, offset, page_id, status (changed, first_only, second_only), lengths and digests."""
    wrong = mismatching_ranges(merkle_tree(first), merkle_tree(second)).select(F.col("archive").alias("w_archive"), F.col("node").alias("w"))

    def suspects(records: DataFrame, side: str) -> DataFrame:
        at = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
        held = records.join(wrong, (F.col("archive") == F.col("w_archive")) & (at == F.col("w")), "left_semi")
        return held.select("archive", "offset", *[F.col(c).alias(f"{c}_{side}") for c in ("page_id", "length", "digest")])

    both = suspects(first, "a").join(suspects(second, "b"), ["archive", "offset"], "full_outer")
    status = F.when(F.col("digest_b").isNull(), "first_only").when(F.col("digest_a").isNull(), "second_only").otherwise("changed")
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select(
        "archive", "offset", F.coalesce("page_id_a", "page_id_b").alias("page_id"), status.alias("status"), "length_a", "length_b", "digest_a", "digest_b"
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    """Audit the two replicas of the pages' archives."""
    return audit(*damaged_replicas(pages))


def oracle(every: int = 61) -> str:
    """DuckDB SQL for the damage that the audit must find."""
    html, half = "coalesce(html, '')", "cast(floor(length(coalesce(html, '')) / 2.0) as int)"

    def record(body: str) -> str:
        return RECORD.replace("\r\n", "' || chr(13) || chr(10) || '").format(bytes=f"strlen({html})", body=body)

    return f"""
with r as (
  select page_id, url, coalesce(cast(floor(page_id / {PAGES_PER_ARCHIVE}.0) as bigint), -1) as grp, {record(html)} as rec,
         {record(f"substr({html}, 1, {half}) || '~' || substr({html}, {half} + 2)")} as flip,
         {record(f"substr({html}, 1, {half})")} as cut,
         cast('0x' || substr(md5(coalesce(url, '')), 1, 6) as bigint) % {every} as fault
  from pages),
a as (select *, grp * {PARTS} + cast('0x' || substr(sha256(rec), 1, 8) as bigint) % cast(ceil(count(*) over (partition by grp) / {ARCHIVE_RECORDS}.0) as bigint) as archive from r),
s as (
  select *, cast(coalesce(sum(strlen(rec)) over (partition by archive order by page_id, url, sha256(rec) rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from a),
t as (
  select *, case when fault = 3 then null else cast(strlen(rec) as bigint) end as length_a, case when fault = 3 then null else sha256(rec) end as digest_a,
         case when fault = 2 then null when fault = 1 then cast(strlen(cut) as bigint) else cast(strlen(rec) as bigint) end as length_b,
         case when fault = 2 then null when fault = 1 then sha256(cut) when fault = 0 then sha256(flip) else sha256(rec) end as digest_b
  from s)
select archive, "offset", page_id, case when digest_b is null then 'first_only' when digest_a is null then 'second_only' else 'changed' end as status,
       length_a, length_b, digest_a, digest_b
from t where digest_a is distinct from digest_b"""
