"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (its non-empty lines, as a set) are hashed to 60-bit numbers.  Each goes to
one cell in each third of a sketch; a cell holds how many came, the exclusive or of their numbers
and that of their check values.  Two sketches subtract cell by cell; what both texts have cancels.
A cell that holds one number is pure: peeling takes it out of its other cells, makes more cells
pure, and ends with the numbers that only one text has.  If cells remain, the pair is retried with
larger sketches: the numbers are dealt to blocks of a bounded size, and a block that fails is tried
at twice the size again.  All of this is column expressions over the rows of one document; no
Python runs on the executors.

Edge cases: a null text is empty and has no paragraphs; two texts without paragraphs have likeness 1,
one of two has likeness 0.  Rows without doc_id come first; rows of one doc_id follow each other by
text; a single row is its own next.  Repeated paragraphs count once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Cells of a fingerprint; a multiple of three.
CELLS = 24
#: Paragraphs of two texts that share a block of the larger sketches, cells of a block at first, and how often they double.
BLOCK, BLOCK_CELLS, RETRIES = 12, 48, 3
ROUNDS = 12
#: Rows that a bucket of the document order should hold, and the most buckets.
BUCKET_ROWS, BUCKETS = 1_000, 16_384
# Primes that place a number in the thirds of a sketch, a triple for each size, and those of its check value.
PLACES = ((2147483647, 2147483629, 2147483587), (2147483579, 2147483563, 2147483549), (2147483543, 2147483497, 2147483489), (2147483477, 2147483423, 2147483399))
CHECK_PRIME, CHECK_FACTOR = 2147483647, 48271

CELL = "struct<n:int,k:bigint,h:bigint>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraph_numbers(text: Column) -> Column:
    """The distinct non-empty lines as 60-bit numbers."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("bigint")))


def check(number: Column) -> Column:
    return (number % CHECK_PRIME) * CHECK_FACTOR % CHECK_PRIME


def place(number: Column, third: int, size: int, attempt: int) -> Column:
    """The cell of a number in a third of a sketch of ``size`` cells."""
    return (third * (size // 3) + number % PLACES[attempt][third] % (size // 3)).cast("int")


def _at(number: Column, cell: Column, size: int, attempt: int) -> Column:
    """Whether a number goes to a cell: it has one place in the cell's third."""
    third = size // 3
    own = F.when(cell < third, place(number, 0, size, attempt)).when(cell < 2 * third, place(number, 1, size, attempt)).otherwise(place(number, 2, size, attempt))
    return own == cell


def sketch(numbers: Column, size: int = CELLS, attempt: int = 0) -> Column:
    """The cells of a set of numbers."""

    def cell(i: Column) -> Column:
        return let(F.filter(numbers, lambda x: _at(x, i, size, attempt)), lambda own: F.struct(
            F.size(own).alias("n"), F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)).alias("k"),
            F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(check(x))).alias("h")))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell)


def subtract(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h")))


def written(cells: Column) -> Column:
    """A sketch as text: count, number and check value of each cell in hexadecimal."""
    fixed = lambda x, width: F.lpad(F.lower(F.hex(x)), width, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lower(F.hex(c["n"])), F.lit("."), fixed(c["k"], 15), fixed(c["h"], 8))), "/")


def peel(cells: Column, size: int = CELLS, attempt: int = 0) -> Column:
    """struct(done, first, second): the numbers that only one side has; ``done`` if no cell remains."""
    state = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("first"), F.array().cast("array<bigint>").alias("second"))

    def pure_cells(now: Column) -> Column:
        return F.filter(now, lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check(c["k"])))

    def taken(now: Column, pure: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            mine = F.filter(pure, lambda p: _at(p["k"], i, size, attempt))
            return F.aggregate(mine, c, lambda a, p: F.struct((a["n"] - p["n"]).alias("n"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(p["h"]).alias("h")))

        side = lambda sign: F.transform(F.filter(pure, lambda p: p["n"] == sign), lambda p: p["k"])
        return F.struct(F.transform(now["cells"], cell).alias("cells"), F.concat(now["first"], side(1)).alias("first"), F.concat(now["second"], side(-1)).alias("second"))

    def step(now: Column, _: Column) -> Column:
        return let(F.array_distinct(pure_cells(now["cells"])), lambda pure: F.when(F.size(pure) == 0, now).otherwise(taken(now, pure)))

    empty = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step)
    return let(ended, lambda s: F.struct(F.forall(s["cells"], empty).alias("done"), s["first"].alias("first"), s["second"].alias("second")))


def _blocks(a: Column, b: Column) -> Column:
    """The two sets dealt to blocks: first by the remainder of a number, then each part by its quotient's."""
    side = F.ceil(F.sqrt(F.ceil((F.size(a) + F.size(b)) / F.lit(BLOCK)))).cast("int")

    def dealt(way: Column, x: Column, y: Column, digit) -> Column:
        return F.transform(F.sequence(F.lit(0), way - 1), lambda i: F.struct(F.filter(x, lambda n: digit(n, way) == i).alias("a"), F.filter(y, lambda n: digit(n, way) == i).alias("b")))

    return let(F.greatest(side, F.lit(1)), lambda way: F.when(way == 1, F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.flatten(F.transform(dealt(way, a, b, lambda n, w: n % w), lambda part: dealt(way, part["a"], part["b"], lambda n, w: F.floor(n / w).cast("bigint") % w)))))


def with_likeness(docs: DataFrame, other: str, name: str) -> DataFrame:
    """Adds the likeness of the sets ``a`` and ``other``: paragraphs of both by those of either.

    The fingerprints ``cells_a`` and ``cells_<other>`` are tried first, then blocks of ever larger sketches.
    """
    part = lambda s, done, first, second: F.struct(s["a"].alias("a"), s["b"].alias("b"), done.alias("done"), first.cast("int").alias("first"), second.cast("int").alias("second"))
    none = F.lit(0)
    docs = docs.withColumn("tried", peel(subtract(F.col("cells_a"), F.col(f"cells_{other}"))))
    rest = F.transform(_blocks(F.col("a"), F.col(other)), lambda s: part(s, F.lit(False), none, none))
    docs = docs.withColumn("blocks", F.when(~F.col("tried.done"), rest).otherwise(F.slice(rest, 1, 0)))
    for attempt in range(1, RETRIES + 1):
        size = BLOCK_CELLS << (attempt - 1)

        def again(s: Column, size=size, attempt=attempt) -> Column:
            return let(peel(subtract(sketch(s["a"], size, attempt), sketch(s["b"], size, attempt)), size, attempt), lambda t: part(s, t["done"], F.size(t["first"]), F.size(t["second"])))

        docs = docs.withColumn("blocks", F.transform("blocks", lambda s: F.when(s["done"], s).otherwise(again(s))))
    # What fails three times, a chance of about one in 10^9 for a block, is compared as sets.
    sizes = F.transform("blocks", lambda s: F.when(s["done"], F.struct(s["first"].alias("first"), s["second"].alias("second"))).otherwise(
        F.struct(F.size(F.array_except(s["a"], s["b"])).alias("first"), F.size(F.array_except(s["b"], s["a"])).alias("second"))))
    docs = docs.withColumn("sizes", F.when(F.col("tried.done"), F.array(F.struct(F.size("tried.first").alias("first"), F.size("tried.second").alias("second")))).otherwise(sizes))
    total = lambda side: F.aggregate("sizes", F.lit(0), lambda n, s: n + s[side])
    docs = docs.withColumns({"only_a": total("first"), "only_b": total("second")}).drop("tried", "blocks", "sizes")
    both = F.size("a") - F.col("only_a")
    near = F.when(both + F.col("only_a") + F.col("only_b") == 0, F.lit(1.0)).otherwise(both.cast("double") / (both + F.col("only_a") + F.col("only_b")))
    return docs.withColumn(name, near).drop("only_a", "only_b")


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each text and that of the next document by ascending doc_id; the last's next is the first.

    The ids' approximate quantiles cut the order into buckets of about ``BUCKET_ROWS`` rows, each a
    window of its own; the first document of a bucket also stands at the end of the bucket before.
    The texts are shuffled once.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = own.select("doc_id")
    rows = ids.count()
    n = min(BUCKETS, max(1, math.ceil(rows / BUCKET_ROWS)))
    cuts = []
    if n > 1:
        cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], min(10 * n, 100_000)).alias("q")).head().q or []
    cuts = sorted(set(cuts))
    width = max(1, math.isqrt(len(cuts)))
    coarse, fine = cuts[::width], [cuts[i : i + width] for i in range(0, len(cuts), width)]
    kind = dict(own.dtypes)["doc_id"]

    def number(column: Column) -> Column:
        """How many cuts are at or below an id; two steps of a square root each."""
        if not cuts:
            return F.lit(0)
        array = lambda x: F.lit(x).cast(f"array<{kind}>")
        below = lambda x: F.size(F.filter(x, lambda c: c <= column))
        parts = F.array(*[array(x) for x in fine])
        return F.coalesce(let(below(array(coarse)), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * width + below(F.element_at(parts, F.greatest(k, F.lit(1)))))), F.lit(0))

    placed = own.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(number(F.col("doc_id"))))
    heads = sorted((r.bucket, r.first is not None, r.first) for r in placed.groupBy("bucket").agg(F.when(F.count("*") > F.count("doc_id"), F.lit(None)).otherwise(F.min("doc_id")).alias("first")).collect())
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}
    first = {b: f for b, _, f in heads}
    spots = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))
    if heads:
        top = heads[-1][0] + 1
        head = F.element_at(F.lit([first.get(b) for b in range(top)]).cast(f"array<{kind}>"), F.col("bucket") + 1)
        prior = F.element_at(F.lit([before.get(b, 0) for b in range(top)]).cast("array<int>"), F.col("bucket") + 1)
        also = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(prior.alias("bucket"), F.lit(True).alias("guest")))
        spots = F.when(F.col("doc_id").eqNullSafe(head), also).otherwise(spots)
    spread = placed.select("doc_id", "text", F.explode(spots).alias("spot")).select("doc_id", "text", "spot.bucket", "spot.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return spread.withColumn("next", F.lead("text").over(order)).where(~F.col("guest")).select("doc_id", "text", "next")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    half = F.floor(F.length("text") / 2).cast("int")
    texts = with_next_text(docs).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half)))
    numbers = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                           paragraph_numbers(F.col("text")).alias("a"), paragraph_numbers(F.col("edited")).alias("b"), paragraph_numbers(F.col("next")).alias("c"))
    cells = numbers.withColumns({f"cells_{x}": sketch(F.col(x)) for x in "abc"})
    near = with_likeness(with_likeness(cells, "b", "near_edited"), "c", "near_next")
    return near.select("doc_id", "n_chars", "edited_sha256", written(F.col("cells_a")).alias("fingerprint"), written(F.col("cells_b")).alias("edited_fingerprint"), "near_edited", "near_next")


def oracle(size: int = CELLS) -> str:
    """DuckDB SQL for the same rows; likeness is that of the paragraph sets themselves."""
    p = PLACES[0]
    spot = ", ".join(f"cast({i * (size // 3)} + k % {q} % {size // 3} as bigint)" for i, q in enumerate(p))
    return f"""
with o as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id nulls first, coalesce(text, '')) as r, count(*) over () as n from documents),
e as (select o.doc_id, o.r, o.t as a, left(o.t, length(o.t) - length(o.t) // 2) || left(x.t, length(o.t) // 2) as b, x.t as c
      from o join o x on x.r = o.r % o.n + 1),
s as (select r, 'a' as v, a as t from e union all select r, 'b', b from e union all select r, 'c', c from e),
k as (select distinct r, v, cast('0x' || substr(md5(l), 1, 15) as bigint) as k from (select r, v, unnest(string_split(t, chr(10))) as l from s) u where l <> ''),
w as (select r, v, unnest([{spot}]) as cell, k from k where v <> 'c'),
g as (select r, v, cell, count(*) as n, bit_xor(k) as x, bit_xor(k % {CHECK_PRIME} * {CHECK_FACTOR} % {CHECK_PRIME}) as h from w group by all),
f as (select q.r, q.v, string_agg(lower(format('{{:x}}', coalesce(g.n, 0))) || '.' || format('{{:015x}}', coalesce(x, 0)) || format('{{:08x}}', coalesce(h, 0)), '/' order by q.cell) as p
      from (select e.r, v, cell from e, (values ('a'), ('b')) y(v), range({size}) z(cell)) q left join g on g.r = q.r and g.v = q.v and g.cell = q.cell group by 1, 2),
m as (select r, v, count(*) as n from k group by 1, 2),
i as (select a.r, b.v, count(*) as n from k a join k b on a.v = 'a' and b.v <> 'a' and a.r = b.r and a.k = b.k group by 1, 2),
j as (select e.r, y.v, coalesce(ma.n, 0) as na, coalesce(mb.n, 0) as nb, coalesce(i.n, 0) as ni
      from e cross join (values ('b'), ('c')) y(v) left join m ma on ma.r = e.r and ma.v = 'a' left join m mb on mb.r = e.r and mb.v = y.v left join i on i.r = e.r and i.v = y.v),
l as (select r, v, case when na + nb = 0 then 1.0::double else ni::double / (na + nb - ni) end as near from j)
select e.doc_id, cast(length(e.a) as bigint) as n_chars, sha256(e.b) as edited_sha256, fa.p as fingerprint, fb.p as edited_fingerprint, lb.near as near_edited, lc.near as near_next
from e join f fa on fa.r = e.r and fa.v = 'a' join f fb on fb.r = e.r and fb.v = 'b' join l lb on lb.r = e.r and lb.v = 'b' join l lc on lc.r = e.r and lc.v = 'c'"""
