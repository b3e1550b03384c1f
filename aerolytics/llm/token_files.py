"""Token-id files: texts become ids, ids become blocks of a shared static numeral system, blocks become checksummed files.

A folder holds ``tables.bin`` (the frequencies of all ids of all documents), files ``part-*.ans`` and
``_manifest.json``, which names the files that count, in order, with the place of their first id.  A file is the blocks' payloads one
after the other and a footer: for each document its id, number of ids and CRC-32 of the ids; for each block (at most
``BLOCK`` ids of one document) its length and CRC-32 of the payload.  Every block is a checkpoint: readers take
slices of a file's documents, seek to their first block and decode from there, in parallel.

Writing: ids are made once and stored; their counts (one histogram a task, at most V rows on the driver) give the table;
the keys alone are dealt to ranges of ascending document ids, of which the driver learns each range's least key and number of
ids; blocks are coded where the ids are, and only coded blocks are shuffled, to their file's task.  Files are written under names of
their own by each attempt of a task, and become part of the folder by the manifest when all tasks are done; what other attempts
left is removed then.

Edge cases: null and empty texts have the end id only; documents without id come first; those with equal ids stand in order of
their ids' checksum, so that many rows of one id spread over several ranges; an empty table makes a manifest without files.  A damaged
block, footer or table is an error when it is read.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from aerolytics.llm import ans
from aerolytics.llm.common import map_batches, shared_dir, ship, small_batches

#: Ids of a block, of a file (about), and of a reader's slice of a file.
BLOCK, FILE_IDS, SLICE_IDS = 4_096, 64 << 20, 8 << 20
#: Bytes of packed ids that are coded at once.
TOGETHER_BYTES = 8 << 20
#: What a document counts in a file's size beside its ids.
DOCUMENT = 64
MAGIC = b"ANSIDS01"
#: Distinct chunks that a worker remembers (from one batch to the next), and their code points together; beyond, the table starts anew.
TABLE_CHUNKS, TABLE_SIGNS = 800_000, 16 << 20


# ---- texts to ids ----


#: Letters outside ASCII that every Unicode version takes for letters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[\x00-\x7f{_LETTERS}]*")
#: Where a byte-level tokenizer cuts texts of these signs.
_CHUNK = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t-\r0-9{_LETTERS}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")

#: A chunk of such signs by itself.
_ALONE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[\\x00-\\x08\\x0e-\\x1f!-/:-@\\[-`{{-\\x7f]+|[ \\t-\\r]+")


class Words:
    """Ids of texts under a byte-level tokenizer, each distinct chunk encoded once by the library's model.

    Such a tokenizer first cuts a text by a fixed pattern.  Texts of ASCII and Latin letters are cut here; of others the
    parts between blanks (before a printable sign, where it always cuts) are, and what has further signs is left to the
    library whole, as are parts with the strings of special tokens and all texts under tokenizers of another build.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        plan = json.loads(self.lib.to_str())
        pre = plan["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and plan["normalizer"] is None and plan["truncation"] is None and plan["padding"] is None
        self.special = [t["content"] for t in plan["added_tokens"]]
        self.parts = bool(plain) and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or _ALONE.fullmatch(t["content"]) for t in plan["added_tokens"])
        if self.parts:
            latin = [chr(c) for c in range(0x250)]
            self.signs_of = {ord(c): self.lib.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin}  # each sign's bytes, as the model spells them
            self.known = Chunks(self)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, and parts that are left to the library."""
        odd = any(map(text.__contains__, self.special))
        if not odd and _PLAIN.fullmatch(text):
            return _CHUNK.findall(text)
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:
            if p and ("!" <= p[0] <= "~" or p[0].isprintable() and unicodedata.category(p[0])[0] not in "CZ"):
                out.append(" " + p)
            else:  # runs of blanks stay together
                out[-1] += " " + p
        cuts = [[p] if odd and any(map(p.__contains__, self.special)) or not _PLAIN.fullmatch(p) else _CHUNK.findall(p) for p in out]
        return list(itertools.chain.from_iterable(cuts))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.parts:
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        if len(self.known) > TABLE_CHUNKS or self.known.signs > TABLE_SIGNS:
            self.known = Chunks(self)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, self.cut(t))), np.uint32) for t in texts]


class Chunks(dict):
    """The packed ids of each distinct chunk, made when it is first asked for."""

    def __init__(self, words: Words):
        self.words, self.signs = words, 0
        self.tokenize, self.spelling = words.lib.model.tokenize, words.signs_of

    def __missing__(self, chunk: str) -> bytes:
        ids = [t.id for t in self.tokenize(chunk.translate(self.spelling))] if _ALONE.fullmatch(chunk) else self.words.whole([chunk])[0]
        self.signs += len(chunk)
        found = self[chunk] = array("I", ids).tobytes()
        return found


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)


def token_ids(docs: DataFrame, tokenizer: str, end: int) -> tuple[DataFrame, int]:
    """(doc_id, seq, crc, n, ids) of each document, and the number of known ids; ``ids`` is packed with ``end`` at its end.  Stored."""
    size = max(words(tokenizer).size, end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.append(x, np.uint32(end)) for x in words(tokenizer).ids([t or "" for t in batch.column("text").to_pylist()])]
        crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), crc, pa.array(list(map(len, rows)), pa.int64()), pa.array([x.astype(kind).tobytes() for x in rows], pa.binary())], ["doc_id", "crc", "n", "ids"])

    found = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, crc long, n long, ids binary")
    path = shared_dir(docs.sparkSession)
    found.withColumn("seq", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path), size


def id_counts(held: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; a task adds up its own before they meet."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    small_batches(held.sparkSession)
    ship(held.sparkSession)
    found = held.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


# ---- ids to files ----


def _order(doc_id: int | None, crc: int, seq: int) -> tuple:
    return (doc_id is not None, doc_id or 0, crc, seq)


def file_ranges(held: DataFrame, file_ids: int = FILE_IDS) -> list[tuple[tuple, int]]:
    """The least key of each range and the number of ids before it, ascending; as many rows as there are files."""
    spark = held.sparkSession
    total = held.agg(F.coalesce(F.sum(F.col("n") + DOCUMENT), F.lit(0))).head()[0]
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_ids))
    key = [F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("crc"), F.col("seq")]
    dealt = held.select(*key, "n").repartitionByRange(count, "named", "doc_id", "crc", "seq")
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("named", "doc_id", "crc", "seq")).alias("low"), F.sum("n").alias("n")).collect()
    rows = sorted((tuple(r.low), r.n) for r in found)
    before = itertools.accumulate([n for _, n in rows], initial=0)
    return [(low, b) for (low, _), b in zip(rows, before, strict=False)]


def coded(held: DataFrame, ranges: list[tuple[tuple, int]], table: ans.Table, size: int) -> DataFrame:
    """(file, named, doc_id, crc, seq, n, sizes, payload): each document's blocks, coded where its ids are."""
    kind = "<u2" if size <= 1 << 16 else "<u4"
    shared = held.sparkSession.sparkContext.broadcast(([low for low, _ in ranges], table.to_bytes()))

    def pack(held: list[pa.RecordBatch], lows: list[tuple], scale: ans.Table) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks()
        rows = [np.frombuffer(x.as_buffer(), kind) for x in batch["ids"]]
        blocks = [x[a : a + BLOCK] for x in rows for a in range(0, len(x), BLOCK)]
        made = ans.encode(blocks, scale)
        cuts = np.cumsum([0, *(-(-len(x) // BLOCK) for x in rows)])
        keys = [_order(*k) for k in zip(*(batch[c].to_pylist() for c in ("doc_id", "crc", "seq")), strict=True)]
        own = [made[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = {
            "file": pa.array([max(bisect_right(lows, k) - 1, 0) for k in keys], pa.int32()), "named": pa.array([k[0] for k in keys]),
            "doc_id": pa.array([k[1] for k in keys], pa.int64()), "crc": pa.array([k[2] for k in keys], pa.int64()), "seq": pa.array([k[3] for k in keys], pa.int64()),
            "n": pa.array(list(map(len, rows)), pa.int64()), "sizes": pa.array([list(map(len, b)) for b in own], pa.list_(pa.int32())), "payload": pa.array([b"".join(b) for b in own], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, packed = shared.value
        scale, held, size = ans.Table.from_bytes(packed), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= TOGETHER_BYTES:  # blocks of several batches share NumPy's steps
                yield pack(held, lows, scale)
                held, size = [], 0
        if held:
            yield pack(held, lows, scale)

    small_batches(held.sparkSession)
    ship(held.sparkSession)
    return held.select("doc_id", "crc", "seq", "ids").mapInArrow(run, "file int, named boolean, doc_id long, crc long, seq long, n long, sizes array<int>, payload binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all documents, in ascending order of their doc_id, as files of ``folder``; it must be one that the driver and all executors share."""
    spark = docs.sparkSession
    ship(spark)
    held, size = token_ids(docs, tokenizer, end)
    table = ans.scaled_table(id_counts(held, size))
    ranges = file_ranges(held, file_ids)
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    _put(store, f"{base}/tables.bin", _sealed(table.to_bytes()))
    rows = coded(held, ranges, table, size).repartitionById(max(len(ranges), 1), "file").sortWithinPartitions("file", "named", "doc_id", "crc", "seq")
    spark.dataSource.register(TokenFiles)
    rows.write.format("token_files").option("path", folder).option("starts", json.dumps([b for _, b in ranges])).option("file_ids", file_ids).mode("append").save()


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = True, slice_ids: int = SLICE_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and on request ids) of each document: ``start`` counts the ids of all documents before it."""
    ship(spark)
    small_batches(spark)
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("path", folder).option("ids", str(keep_ids).lower()).option("slice_ids", slice_ids).load()


# ---- the files ----


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _put(store, path: str, data: bytes) -> None:
    """A small file, written aside and renamed."""
    with store.open_output_stream(f"{path}.part") as out:
        out.write(data)
    store.move(f"{path}.part", path)


def _sealed(data: bytes) -> bytes:
    return data + np.array([zlib.crc32(data)], "<u4").tobytes()


def _unsealed(data: bytes, what: str) -> bytes:
    if len(data) < 4 or zlib.crc32(data[:-4]) != int(np.frombuffer(data[-4:], "<u4")[0]):
        raise ValueError(f"{what} is damaged")
    return data[:-4]


class _File:
    """One file as it is written."""

    def __init__(self, store, path: str, first: int):
        self.sink, self.first, self.at, self.ids = store.open_output_stream(path), first, 0, 0
        self.docs: list[tuple[int, int, int, int]] = []
        self.blocks: list[tuple[int, int]] = []

    def add(self, named: bool, doc_id: int, n: int, crc: int, sizes: list[int], payload: bytes) -> None:
        view = memoryview(payload)
        for size in sizes:
            self.blocks.append((size, zlib.crc32(view[:size])))
            view = view[size:]
        self.sink.write(payload)
        self.docs.append((int(named), doc_id, n, crc))
        self.at += len(payload)
        self.ids += n

    def close(self) -> int:
        docs, blocks = np.array(self.docs, "<i8").reshape(-1, 4), np.array(self.blocks, "<u4").reshape(-1, 2)
        footer = _sealed(np.array([self.first, len(docs), len(blocks)], "<i8").tobytes() + docs.tobytes() + blocks.tobytes())
        self.sink.write(footer + np.array([len(footer)], "<i8").tobytes() + MAGIC)
        self.sink.close()
        return self.at + len(footer) + 16


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Slice(InputPartition):
    file: str
    bytes: int
    low: int
    high: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.file_ids = options["path"], int(options["file_ids"])
        self.starts = json.loads(options["starts"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.folder)
        files: list[dict] = []
        current, out, entry = None, None, {}

        def close() -> None:
            if out is not None:
                files.append(entry | {"ids": out.ids, "docs": len(out.docs), "bytes": out.close()})

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("file", "named", "doc_id", "n", "crc", "sizes", "payload")]
            for file, named, doc_id, n, crc, sizes, payload in zip(*columns, strict=True):
                if file != current or out.ids + DOCUMENT * len(out.docs) >= 2 * self.file_ids:
                    close()
                    first = self.starts[file] if file != current else out.first + out.ids
                    entry = {"name": f"part-{file:07d}-{first}-{uuid.uuid4().hex}.ans", "first": first}
                    current, out = file, _File(store, f"{base}/{entry['name']}", first)
                out.add(named, doc_id, n, crc, sizes, payload)
        close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.folder)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        _put(store, f"{base}/_manifest.json", json.dumps({"files": files}).encode())
        names = {f["name"] for f in files}
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.base_name.endswith(".ans") and info.base_name not in names:
                store.delete_file(info.path)  # of an attempt that doesn't count, or of what was here before

    def abort(self, messages) -> None:
        store, base = _store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{base}/{f['name']}")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.ids, self.slice_ids = options["path"], options.get("ids", "true") == "true", int(options.get("slice_ids", SLICE_IDS))

    def partitions(self) -> list[Slice]:
        store, base = _store(self.folder)
        with store.open_input_stream(f"{base}/_manifest.json") as held:
            files = json.loads(held.read())["files"]
        return [Slice(f["name"], f["bytes"], f["first"] + a, f["first"] + a + self.slice_ids) for f in files for a in range(0, f["ids"], self.slice_ids)] or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, base = _store(self.folder)
        with store.open_input_stream(f"{base}/tables.bin") as held:
            table = ans.Table.from_bytes(_unsealed(held.read(), "the frequency table"))
        with store.open_input_file(f"{base}/{part.file}") as held:
            held.seek(part.bytes - 16)
            size, magic = int(np.frombuffer(held.read(8), "<i8")[0]), held.read(8)
            if magic != MAGIC or not 0 < size <= part.bytes - 16:
                raise ValueError(f"{part.file} isn't whole")
            held.seek(part.bytes - 16 - size)
            footer = _unsealed(held.read(size), f"the footer of {part.file}")
            first, n_docs, n_blocks = np.frombuffer(footer, "<i8", 3)
            docs = np.frombuffer(footer, "<i8", n_docs * 4, 24).reshape(-1, 4)
            blocks = np.frombuffer(footer, "<u4", n_blocks * 2, 24 + n_docs * 32).reshape(-1, 2).astype(np.int64)
            starts = first + np.cumsum(docs[:, 2]) - docs[:, 2]
            until = np.cumsum(-(-docs[:, 2] // BLOCK))  # blocks up to each document's end
            places = np.concatenate(([0], np.cumsum(blocks[:, 0])))
            a, b = np.searchsorted(starts, [part.low, part.high], "left")
            while a < b:
                c = max(a + 1, int(np.searchsorted(starts, starts[a] + (ans.TOGETHER >> (1 if self.ids else 0)), "left")))
                c = min(c, a + 10_000, b)
                from_block, to_block = int(until[a - 1]) if a else 0, int(until[c - 1])
                held.seek(int(places[from_block]))
                yield self._rows(held, docs[a:c], starts[a:c], blocks[from_block:to_block], table, part.file)
                a = c

    def _rows(self, held, docs, starts, blocks, table: ans.Table, file: str) -> pa.RecordBatch:
        payloads = [held.read(int(size)) for size in blocks[:, 0]]
        if any(zlib.crc32(p) != crc for p, crc in zip(payloads, blocks[:, 1].tolist(), strict=True)):
            raise ValueError(f"a block of {file} is damaged")
        counts = -(-docs[:, 2] // BLOCK)
        last = np.cumsum(counts) - 1
        sizes = np.full(len(blocks), BLOCK, np.int64)
        sizes[last] = docs[:, 2] - (counts - 1) * BLOCK
        ids = np.concatenate(ans.decode(payloads, sizes, table)).astype("<u4")
        cuts = np.concatenate(([0], np.cumsum(docs[:, 2])))
        crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if crc != docs[:, 3].tolist():
            raise ValueError(f"{file} gives other ids than were written")
        named = docs[:, 0] == 0
        columns = {"doc_id": pa.array(docs[:, 1].copy(), pa.int64(), mask=named), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(docs[:, 2].copy(), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if self.ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class TokenFiles(DataSource):
    """``token_files``: options ``path``, ``ids`` and ``slice_ids`` to read; the writer is ``write_token_files``'s."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if self.options.get("ids", "true") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))
