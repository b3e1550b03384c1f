"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has two levels of bounded shards, written to the shared folder by Spark tasks:

* words: ascending 60-bit word hashes and running totals of their counts, both Elias-Fano coded;
  a word's id is its rank;
* successors: for the contexts of a shard, monotone pointers (Elias-Fano) to their children, the
  children as the monotone sequence ``context * V + word`` (Elias-Fano), and a quantised log10 of
  each child's discounted probability.

Readers map the files into memory.  A bigram is looked up by successor search among its context's
children; the number of children also gives the mass that is left to unseen words:
p(w|c) = max(n(c,w)-D, 0)/n(c) + D*T(c)/n(c) * p(w), and p(w) = (n(w)+0.5)/(N+0.5*(V+1)).
Probabilities are rounded down, so that they never add up to more than 1.

Counts cover all training documents: tasks add up their own share, and shuffles merge the shares.
A frequent context is split over several shards by word, so none outgrows a task.

Edge cases: null and empty texts hold the end token alone; the context of a first word is the end
token; without training documents every token counts as the one unknown word (probability 1); repeated rows are
counted and scored one by one; a text of any length is taken in pieces cut at blanks.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import doc_crc, shared_dir, ship, small_batches, stored, utf8_rows

END = b"\n"  # no word can hold a line end
HASH_BITS = 60
DISCOUNT = 0.75
#: Words of a shard of the first level, tokens of one of the second, steps of a quantised unit of log10.  Only the sizes of files depend on the first two.
SHARD_WORDS, SHARD_TOKENS, STEPS = 500_000, 2_000_000, 4_096
#: Tokens that a task handles at once, bytes of a text cut off at once, and distinct words whose counts a task holds.
CHUNK, PIECE, HELD = 1_000_000, 4 << 20, 400_000
#: Bytes of shards that a worker keeps open (mapped, or in memory where the store is no file system).
OPEN_BYTES = 256 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# ---- Elias-Fano sequences ----


class EliasFano:
    """An ascending sequence in blocks of 32: a base, one 64-bit word of upper bits and whole bytes of lower bits each."""

    BLOCK = 32

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.size = int(arrays[f"{name}.size"][0])
        self.base, self.start, self.width, self.upper, self.low = (arrays[f"{name}.{x}"] for x in ("base", "start", "width", "upper", "low"))

    @classmethod
    def encode(cls, values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        """Arrays by name; values below 2^61."""
        values = np.asarray(values, np.uint64)
        k, n = cls.BLOCK, len(values)
        rows = np.concatenate((values, np.full(-n % k, values[-1] if n else 0, np.uint64))).reshape(-1, k)
        base = rows[:, 0].copy()
        rows = rows - base[:, None]
        width = np.zeros(len(rows), np.uint8)
        for i in range(7):
            width += rows[:, -1] >= np.uint64(k << (8 * i))
        high = rows >> (width.astype(np.uint64) * np.uint64(8))[:, None]
        upper = np.bitwise_or.reduce(np.uint64(1) << (high + np.arange(k, dtype=np.uint64)), axis=1) if len(rows) else np.empty(0, np.uint64)
        ends = np.cumsum(width.astype(np.int64) * k)
        start = ends - width.astype(np.int64) * k
        low = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        parts = rows.astype("<u8").view(np.uint8).reshape(-1, k, 8)
        for w in range(1, 8):
            of = np.flatnonzero(width == w)
            low[start[of][:, None] + np.arange(k * w)] = parts[of][:, :, :w].reshape(len(of), k * w)
        found = {"size": np.array([n], np.int64), "base": base, "start": start, "width": width, "upper": upper, "low": low}
        return {f"{name}.{x}": v for x, v in found.items()}

    def blocks(self, at: np.ndarray) -> np.ndarray:
        """The values of whole blocks, a row each."""
        k = self.BLOCK
        ones = np.unpackbits(np.ascontiguousarray(self.upper[at]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        high = np.flatnonzero(ones).reshape(-1, k) - (64 * np.arange(len(at)))[:, None] - np.arange(k)
        width, start = self.width[at], self.start[at]
        values = self.base[at][:, None] + (high.astype(np.uint64) << (width.astype(np.uint64) * np.uint64(8))[:, None])
        for w in np.unique(width):
            if w:
                of = np.flatnonzero(width == w)
                found = self.low[start[of][:, None] + np.arange(k * int(w))].reshape(-1, k, int(w))
                for i in range(int(w)):
                    values[of] += found[:, :, i].astype(np.uint64) << np.uint64(8 * i)
        return values

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at given positions."""
        own, row = np.unique(at // self.BLOCK, return_inverse=True)
        return self.blocks(own)[row, at % self.BLOCK]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys by successor search; -1 for those that are absent."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        keys = keys.astype(np.uint64)
        block = np.searchsorted(self.base, keys, "right") - 1
        own, row = np.unique(np.maximum(block, 0), return_inverse=True)
        values = self.blocks(own)
        inside = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), 65_536):
            inside[i : i + 65_536] = (values[row[i : i + 65_536]] < keys[i : i + 65_536, None]).sum(axis=1)
        fits = np.minimum(inside, self.BLOCK - 1)
        at = own[row] * self.BLOCK + fits
        return np.where((block >= 0) & (inside < self.BLOCK) & (values[row, fits] == keys) & (at < self.size), at, -1)


# ---- files of arrays ----


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray], attempt: str) -> None:
    """One file: a header, then the arrays at multiples of 8 bytes.  Written aside, then renamed: a repeated task does no harm."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, at, len(x))
        at += x.nbytes + -x.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    from pyarrow import fs

    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.{attempt}") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    try:
        store.move(f"{path}.{attempt}", path)
    except OSError:  # where renaming does not replace: another attempt wrote the same content
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(f"{path}.{attempt}")


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the store is a file system."""
    from pyarrow import fs

    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_file(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    n = int(data[:8].view("<i8")[0])
    at = 8 + n
    return {name: data[at + s : at + s + m * np.dtype(kind).itemsize].view(kind) for name, (kind, s, m) in json.loads(bytes(data[8:at])).items()}


# ---- tokens ----


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - HASH_BITS)


def tokens_of(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The tokens of a text in pieces, with whether the piece is the last; the end token closes it."""
    at = 0
    while len(text) - at > PIECE and (cut := _BLANK.search(text, at + PIECE)):
        yield text[at : cut.start()].lower().split(), False
        at = cut.end()
    words = text[at:].lower().split()
    words.append(END)
    yield words, True


@dataclass
class Chunk:
    """Tokens of consecutive texts: words, the word before each stretch, and which row each stretch belongs to."""

    words: list[bytes] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    before: list[bytes] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def numbered(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, and the local numbers of each token and of its context."""
        known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        own = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[self.starts] = [known[w] for w in self.before]
        return list(known), own, context


def chunks(texts: Iterable[bytes]) -> Iterator[Chunk]:
    held = Chunk()
    for row, text in enumerate(texts):
        last = END
        for words, _ in tokens_of(text):
            if not words:
                continue
            held.starts.append(len(held.words))
            held.before.append(last)
            held.rows.append(row)
            held.words += words
            last = words[-1]
            if len(held.words) >= CHUNK:
                yield held
                held = Chunk()
    if held.words:
        yield held


# ---- the model ----


@dataclass
class Trie:
    """Where the levels are, and the few numbers that readers need: a pair for each shard of words (500,000 distinct words each),
    and T for contexts that are split, which are words of over ``shard_tokens`` occurrences.  Shards of the second level tell
    their range themselves, so nothing here grows with their number."""

    path: str
    total: int
    distinct: int
    bits: int
    first: list[tuple[int, int]]
    split: dict[int, int]
    shard_tokens: int = SHARD_TOKENS

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of a token's probability from its count alone."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def shards(self, running: np.ndarray, counts: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The second-level shard of (context, word); ascends with the pair."""
        within = np.where(counts > self.shard_tokens, counts * (word / max(self.distinct, 1)), 0.0)
        return np.floor((running + within) / self.shard_tokens).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values, none below 0."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True)) if cuts else []


class Reader:
    """Look-ups in a trie; one for each worker."""

    _open: dict[str, "Reader"] = {}

    def __init__(self, trie: Trie):
        self.trie, self.held, self.size = trie, OrderedDict(), 0

    @classmethod
    def of(cls, trie: Trie) -> "Reader":
        if trie.path not in cls._open:
            cls._open.clear()
            cls._open[trie.path] = cls(trie)
        found = cls._open[trie.path]
        found.trie = trie  # while it is built, the same path has ever more levels
        return found

    def part(self, level: str, shard: int, names: tuple[str, ...]) -> tuple[dict[str, np.ndarray], dict[str, EliasFano]] | None:
        """A shard's arrays and sequences, None if there is no such shard; the least recently used go beyond ``OPEN_BYTES``."""
        key = level, shard
        if key not in self.held:
            try:
                arrays = open_arrays(f"{self.trie.path}/{level}/{shard:06d}")
            except FileNotFoundError:
                arrays = {}
            self.held[key] = (arrays, {n: EliasFano(arrays, n) for n in names}) if arrays else None
            self.size += sum(x.nbytes for x in arrays.values())
            while self.size > OPEN_BYTES and len(self.held) > 1:
                _, old = self.held.popitem(last=False)
                self.size -= sum(x.nbytes for x in old[0].values()) if old else 0
        self.held.move_to_end(key)
        return self.held[key]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: unknown), count, and the count of all words before, of distinct words."""
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        ids, counts, running = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(hashes, kind="stable")
        shard = (hashes[order] >> np.uint64(HASH_BITS - self.trie.bits)).astype(np.int64)
        for s, e in _runs(shard):
            first_id, first_total = self.trie.first[shard[s]]
            if first_id < 0:
                continue
            _, parts = self.part("words", int(shard[s]), ("hash", "total"))
            at = parts["hash"].find(hashes[order[s:e]])
            own, at = order[s:e][at >= 0], at[at >= 0]
            both = parts["total"].get(np.concatenate((at, at + 1))).astype(np.int64).reshape(2, -1)
            ids[own], counts[own], running[own] = at + first_id, both[1] - both[0], both[0] + first_total
        return ids, counts, running

    def totals(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by ascending id."""
        out = np.zeros(len(ids), np.int64)
        full = [(f, s) for s, (f, _) in enumerate(self.trie.first) if f >= 0]
        starts = np.array([f for f, _ in full])
        shard = np.searchsorted(starts, ids, "right") - 1
        for i in np.unique(shard):
            of = np.flatnonzero(shard == i)
            at = ids[of] - starts[i]
            _, parts = self.part("words", full[i][1], ("hash", "total"))
            both = parts["total"].get(np.concatenate((at, at + 1))).astype(np.int64).reshape(2, -1)
            out[of] = both[1] - both[0]
        return out

    def successors(self, shard: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending pairs in one shard: the quantised child (-1: none), and how many children the context has here."""
        found = self.part("successors", shard, ("pointer", "child"))
        if found is None:
            return np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        arrays, parts = found
        low, high = arrays["range"].tolist()
        inside = (context >= low) & (context <= high)
        at = np.where(inside, context - low, 0)
        children = np.diff(parts["pointer"].get(np.stack((at, at + 1))).astype(np.int64), axis=0)[0]
        children[~inside] = 0
        code = np.full(len(context), -1, np.int64)
        some = np.flatnonzero(children > 0)
        place = parts["child"].find((context[some] - low).astype(np.uint64) * np.uint64(self.trie.distinct) + word[some].astype(np.uint64))
        code[some[place >= 0]] = arrays["code"][place[place >= 0]]
        return code, children

    def score(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of a chunk: known tokens, base score, and the model's score."""
        trie = self.trie
        distinct, own, context = chunk.numbered()
        ids, counts, running = self.words(distinct)
        base = trie.base(counts)
        pair, where = np.unique(context * len(distinct) + own, return_inverse=True)
        c, w = np.divmod(pair, len(distinct))
        score = base[w].copy()
        seen = np.flatnonzero(ids[c] >= 0)  # an unknown context leaves all to the word
        word = np.maximum(ids[w[seen]], 0)
        order = np.lexsort((word, ids[c[seen]]))
        seen, word = seen[order], word[order]
        shard = trie.shards(running[c[seen]], counts[c[seen]], word)
        for s, e in _runs(shard):
            of = seen[s:e]
            left, right = ids[c[of]], ids[w[of]]
            code, children = self.successors(int(shard[s]), left, np.maximum(right, 0))
            code = np.where(right >= 0, code, -1)
            if trie.split:
                children = np.array([trie.split.get(x, n) for x, n in zip(left.tolist(), children.tolist(), strict=True)], np.int64)
            mass = DISCOUNT * children / counts[c[of]]
            p = mass * 10.0 ** base[w[of]] + np.where(code >= 0, 10.0 ** (-code / STEPS), 0.0)
            score[of] = np.log10(p)
        add = lambda x: np.add.reduceat(x, chunk.starts)
        return add((counts[own] > 0).astype(np.int64)), add(base[own]), add(score[where])


# ---- building ----


def _count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) over all texts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in held], pa.int64()), pa.array(list(held.values()), pa.int64())], ["hash", "n"])
            held.clear()
            return found

        for batch in batches:
            for text in utf8_rows(batch.column("text")):
                for words, _ in tokens_of(text):
                    held.update(words)
                if len(held) > HELD:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _build_words(counts: DataFrame, path: str, shard_words: int) -> tuple[int, list[tuple[int, int]], int, int]:
    """Write the first level; the bits of a shard's number, first id and total of each shard, N and V."""
    bits = max(0, math.ceil(math.log2(max(1, counts.count()) / shard_words)))

    def build(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        shard = table.column("shard")[0].as_py()
        hashes, n = table.column("hash").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(hashes)
        total = np.concatenate(([0], np.cumsum(n[order])))
        write_arrays(f"{path}/words/{shard:06d}", EliasFano.encode(hashes[order], "hash") | EliasFano.encode(total, "total"), str(TaskContext.get().taskAttemptId()))
        return pa.table({"shard": pa.array([shard], pa.int64()), "words": pa.array([len(n)], pa.int64()), "tokens": pa.array([int(total[-1])], pa.int64())})

    shard = F.shiftright("hash", HASH_BITS - bits) if bits else F.lit(0).cast("long")
    made = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, words long, tokens long")
    found = {r.shard: (r.words, r.tokens) for r in made.toLocalIterator()}  # one row for each shard
    first, ids, tokens = [], 0, 0
    for s in range(2**bits):
        first.append((ids, tokens) if s in found else (-1, -1))
        ids, tokens = ids + found.get(s, (0, 0))[0], tokens + found.get(s, (0, 0))[1]
    return bits, first, tokens, ids


def _packed(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending pairs and their counts in few bytes: steps of context, words, small counts, and those that are not small."""
    steps = np.diff(context, prepend=0)
    wide = np.uint64 if len(word) and max(int(word.max()), int(steps.max())) >> 32 else np.uint32
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.array([len(word), np.dtype(wide).itemsize], np.int64).tobytes() + steps.astype(wide).tobytes() + word.astype(wide).tobytes() + small.tobytes() + counts[small == 255].astype(np.int64).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    kind = np.uint64 if width == 8 else np.uint32
    steps = np.frombuffer(data, kind, n, 16)
    word = np.frombuffer(data, kind, n, 16 + n * width)
    counts = np.frombuffer(data, np.uint8, n, 16 + 2 * n * width).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint8, offset=16 + n * (2 * width + 1)).copy().view(np.int64)
    return np.cumsum(steps.astype(np.int64)), word.astype(np.int64), counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[cuts], np.add.reduceat(counts[order], cuts) if len(keys) else counts


def _build_successors(docs: DataFrame, trie: Trie) -> None:
    """Count bigrams and write the second level; fills the trie's split contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(trie)
        for chunk in chunks(t for batch in batches for t in utf8_rows(batch.column("text"))):
            distinct, own, context = chunk.numbered()
            ids, counts, running = reader.words(distinct)
            pair, n = np.unique(context * len(distinct) + own, return_counts=True)
            c, w = np.divmod(pair, len(distinct))
            order = np.lexsort((ids[w], ids[c]))
            c, w, n = c[order], w[order], n[order]
            shard = trie.shards(running[c], counts[c], ids[w])
            spans = _runs(shard)
            data = [_packed(ids[c[s:e]], ids[w[s:e]], n[s:e]) for s, e in spans]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[s]) for s, _ in spans], pa.int64()), pa.array(data, pa.binary())], ["shard", "data"])

    def build(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        shard = table.column("shard")[0].as_py()
        parts = [_unpacked(x.as_py()) for x in table.column("data")]
        low = min(int(c[0]) for c, _, _ in parts)
        size = max(trie.distinct, 1)
        keys, counts = _summed(np.concatenate([(c - low) * size + w for c, w, _ in parts]), np.concatenate([n for _, _, n in parts]))
        context = keys // size
        high = int(context[-1])
        pointer = np.searchsorted(context, np.arange(high + 2))
        total = Reader.of(trie).totals(np.arange(low, low + high + 1))[context]
        code = np.minimum(np.ceil(-np.log10((counts - DISCOUNT) / total) * STEPS), 65_535).astype(np.uint16)
        write_arrays(f"{trie.path}/successors/{shard:06d}", EliasFano.encode(pointer, "pointer") | EliasFano.encode(keys, "child") | {"code": code, "range": np.array([low, low + high], np.int64)}, str(TaskContext.get().taskAttemptId()))
        split = [(low + int(i), int(pointer[i + 1] - pointer[i])) for i in np.unique(context[total > trie.shard_tokens])]
        return pa.table({"shard": pa.array([shard], pa.int64()), "split": pa.array([[x for y in split for x in y]], pa.list_(pa.int64()))})

    made = docs.select("text").mapInArrow(count, "shard long, data binary").groupBy("shard").applyInArrow(build, "shard long, split array<long>")
    for r in made.where("size(split) > 0").toLocalIterator():  # the shards of the most frequent words
        for c, n in zip(r.split[::2], r.split[1::2], strict=True):
            trie.split[c] = trie.split.get(c, 0) + n


def train(docs: DataFrame, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """Build the trie of all ``text`` of the given documents."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    path = shared_dir(spark)
    bits, first, total, distinct = _build_words(stored(_count_words(docs)), path, shard_words)
    trie = Trie(path, total, distinct, bits, first, {}, shard_tokens)
    _build_successors(docs, trie)
    return trie


def score_documents(docs: DataFrame, trie: Trie) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            known, tokens, base, score = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float))
            for chunk in chunks(utf8_rows(batch.column("text"))):
                a, b, c = reader.score(chunk)
                np.add.at(known, chunk.rows, a)
                np.add.at(base, chunk.rows, b)
                np.add.at(score, chunk.rows, c)
                np.add.at(tokens, chunk.rows, np.diff(chunk.starts, append=len(chunk.words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(known), pa.array(np.full(batch.num_rows, shared.value.total)), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out() -> Column:
    return F.coalesce(doc_crc(), F.lit(0)) % 5 == 1


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out (crc32 of the id mod 5 is 1), score all."""
    trie = train(docs.where(~held_out()))
    found = score_documents(docs, trie)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
