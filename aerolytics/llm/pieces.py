"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character (checked when the
model is loaded), so a normalised text falls into chunks - a run of markers and what follows -
that are segmented apart from each other.  Each worker encodes and decodes a distinct chunk once, as long
as its table holds it (``TABLE_CHUNKS`` chunks of ``TABLE_SIGNS`` code points together, then it starts
anew); the ids of a text are its chunks' ids, joined back by position.

Edge cases: null and empty texts have no ids and decode to the empty text.  A literal U+2581
is a marker, as in the library.  Repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from aerolytics.llm.common import free_names, map_batches, schema_with

MARK = "▁"
#: Distinct chunks that a worker remembers; beyond, the table starts anew.
TABLE_CHUNKS, TABLE_SIGNS = 400_000, 16 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_loaded: dict[str, "ChunkTable"] = {}


class ChunkTable:
    """Ids and decoded text of distinct chunks under one model."""

    def __init__(self, model: str, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(re.search(f"[^{MARK}]{MARK}", self.lib.id_to_piece(i)) for i in range(self.lib.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.lib.encode("a b") != self.lib.encode("a") + self.lib.encode("b") or self.lib.encode(" a") == self.lib.encode("a"):
            raise ValueError("this model's normalisation isn't the plain one that the chunks rely on")
        self.limit = limit
        self.known: dict[str, tuple[bytes, bool]] = {}
        self.signs = 0
        self.alone = self.lib.piece_to_id(MARK)

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that the table lacks: ids as text, and whether decoding gives the chunk back."""
        new = list(chunks.difference(self.known))
        if len(self.known) + len(new) > self.limit or self.signs > TABLE_SIGNS:
            self.known.clear()
            self.signs, new = 0, list(chunks)
        self.signs += sum(map(len, new))
        plain = [c[1:].replace(MARK, " ") for c in new]
        ids = [x or [self.alone] for x in self.lib.encode(plain, num_threads=1)]  # a marker alone is a piece of its own
        back = self.lib.decode([[self.alone, *x] for x in ids], num_threads=1)
        for chunk, x, text in zip(new, ids, back, strict=True):
            self.known[chunk] = (",".join(map(str, x)).encode(), text == chunk.replace(MARK, " "))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Decimal ids joined by commas, and the decoded text, of each text."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*cut))
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            found = [self.known[c] for c in chunks]
            ids = b",".join([x for x, _ in found])
            if all([same for _, same in found]):
                back = text.replace(MARK, " ")
            else:  # a chunk that doesn't survive: the library decodes the whole
                back = self.lib.decode([int(x) for x in ids.split(b",")])
            out.append((ids, back))
        return out


def table(model: str) -> ChunkTable:
    if model not in _loaded:
        _loaded[model] = ChunkTable(model)
    return _loaded[model]


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = True, keep_text: bool = False, keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids and the decoded text.

    ``keep_columns`` puts all columns of ``docs`` before them, names taken there get an underscore at their end.
    """
    wanted = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if keep_ids:
        wanted["ids"] = "array<int>"
    if keep_text:
        wanted["decoded"] = "string"
    base = docs if keep_columns else docs.select("doc_id", "text")
    kept = base.columns if keep_columns else ["doc_id"]
    names = free_names(base, *wanted) if keep_columns else list(wanted)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = table(model).encode([x or "" for x in batch.column("text").to_pylist()])
        made = {
            "n_tokens": pa.array([ids.count(b",") + 1 if ids else 0 for ids, _ in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(back.encode()).hexdigest() for _, back in found], pa.string()),
        }
        if keep_ids:
            made["ids"] = pa.array([[int(x) for x in ids.split(b",")] if ids else [] for ids, _ in found], pa.list_(pa.int32()))
        if keep_text:
            made["decoded"] = pa.array([back for _, back in found], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made.values()], [*kept, *names])

    own = base if keep_columns else base.select("doc_id")
    return map_batches(base, encode, schema_with(own, **dict(zip(names, wanted.values(), strict=True))))
