"""Secret scan: fixed patterns, then dictionary-primed zstandard novelty.

The base patterns (assign, access, hex) are reported as they are.  Beside them, every run of
``LEAST`` key characters or more that stands within ``REACH`` code points of a sensitive word, before it or
after it, is a candidate: what it adds to the compressed size of its surroundings, further
copies of it taken out, under a dictionary of common identifiers, tells how new it is.  A candidate
that hardly shrinks is reported as ``novel`` unless base spans hold all of it.

Nothing but the compressor rejects a candidate.  What holds both letters and digits counts as new from
``NOVELTY`` added bytes by byte on; letters of both cases, or digits alone, carry less, so ``PLAIN_NOVELTY`` holds
for them, and ``WORD_NOVELTY`` for what is written like a word.  Over the 10,000 documents of 0.1, none of which holds
such a secret by its making, 4 spans are novel (numbers of 16 digits); of random keys of 12 to 64 signs beside a
sensitive word, 99 to 100 of 100 are found with letters and digits, with letters of both cases and in base 64, 100 of
digits up to 20 signs, and none of longer digits or of lower-case letters alone.

Spans are ``kind:start:end`` in code points, end exclusive.  Null and empty texts have no
spans; repeated rows are scanned one by one; a text of any length is scanned whole, and its candidates
are compressed with a bounded part of it; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from aerolytics.llm.common import map_batches

# The base patterns, their least lengths, and the words that make a context sensitive.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile("AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|authorization|bearer|signature", re.IGNORECASE | re.ASCII)
LEAST = 12  # code points of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_KEY_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: What carries a candidate on beyond the reach: a part after a dot, or a next line of key characters alone.
PART = re.compile(r"\.([A-Za-z0-9+/_=-]+)")
LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_=-]+)(?=[ \t]*(?:\r?\n|\Z))")
#: A private key in its armour (or to the end of a text that cuts it off), in which all is within reach, and its closing line.
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END|\Z)", re.DOTALL)
CLOSING = re.compile(r"\s*(?:=[A-Za-z0-9+/]{4}\s*)?-----END")
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key credential authorization bearer signature "
    "username user_name email account client_id client_secret session_id request response config settings environment variable "
    "function return import export default public static private const class string number boolean object array value index length "
    "example placeholder changeme your_token_here your_api_key_here insert_key_here localhost database connection timeout version "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 abcdef0123456789 xxxxxxxxxxxxxxxx ----------------"
)

#: Code points between a sensitive word and a candidate, and those of its surroundings on each side that prime the compressor.
REACH, AROUND = 64, 1_024
#: Added compressed bytes by byte of the candidate from which on it counts as incompressible: in general, for letters or digits alone, and for letters of one case.
NOVELTY, PLAIN_NOVELTY, WORD_NOVELTY = 0.6, 0.8, 1.1

_press: list[zstandard.ZstdCompressor] = []


def _compressor() -> zstandard.ZstdCompressor:
    """One for each worker; primed with the identifiers."""
    if not _press:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _press.append(zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False))
    return _press[0]


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to its compressed surroundings, by byte of its own."""
    press, own = _compressor(), around.encode()
    return (len(press.compress(own + candidate.encode())) - len(press.compress(own))) / len(candidate.encode())


def needed(candidate: str) -> float:
    """The novelty that a candidate of its signs needs."""
    if re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", candidate):
        return WORD_NOVELTY
    return NOVELTY if re.search("[0-9]", candidate) and re.search("[A-Za-z]", candidate) else PLAIN_NOVELTY


def surroundings(text: str, start: int, end: int) -> str:
    """What stands around a candidate, without its further copies (also those of its parts beside an equals sign), which would make it look old."""
    own = text[start:end]
    wide = AROUND + end - start  # copies that the edge would cut go whole
    before, after = text[max(0, start - wide) : start], text[end : end + wide]
    for part in (own, *(x for x in own.split("=") if len(x) >= LEAST)):
        before, after = before.replace(part, " "), after.replace(part, " ")
    return before[-AROUND:] + after[:AROUND]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns; leftmost and non-overlapping in each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def covered(base: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """Whether sorted base spans together hold all of a range."""
    for s, _, e in base:
        if s <= start < e:
            start = e
    return start >= end


def sensitive_ranges(text: str) -> list[tuple[int, int]]:
    """Merged ranges within reach of a sensitive word; armoured keys are within reach as a whole."""
    found = [(max(0, m.start() - REACH), m.end() + REACH) for m in SENSITIVE.finditer(text)]
    if found:
        found += [m.span() for m in ARMOUR.finditer(text)]
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of incompressible candidates in a sensitive context that base spans don't cover whole.

    A candidate goes on past the reach in parts joined by dots and in next lines of key characters.
    After a dot or in armour, the continuation of a novel one counts with letters or digits alone as it would with
    both; the short last line of an armoured key goes with it.
    """
    ranges = sensitive_ranges(text)
    out, seen, armoured = [], 0, [m.span() for m in ARMOUR.finditer(text)] if ranges else []
    for low, high in ranges:
        at = max(low, seen)
        while at > seen and text[at - 1] in _KEY_SIGNS:  # a candidate that begins before the range
            at -= 1
        while near := CANDIDATE.search(text, at, high + LEAST):
            if near.start() > high:
                break
            m = CANDIDATE.match(text, near.start())  # to its own end, which may lie beyond the reach
            start, end, told = m.start(), m.end(), False
            while True:
                part = text[start:end]
                if len(part) >= LEAST:
                    loose = told and (text[start - 1] == "." or any(s <= start and end <= e for s, e in armoured))
                    told = novelty(part, surroundings(text, start, end)) >= (NOVELTY if loose else needed(part))
                else:
                    told = told and bool(CLOSING.match(text, end))
                if told and not covered(base, start, end):
                    out.append((start, 3, end))
                at = seen = end
                more = PART.match(text, end) or len(part) >= LEAST and LINE.match(text, end)
                if not more:
                    break
                start, end = more.span(1)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, novel_spans(text, base)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan_text(x or "") for x in batch.column("text").to_pylist()]
        count = lambda k: pa.array([sum(1 for x in base if x[1] == k) for base, _ in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]), pa.array([written(base + more) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
        )

    return map_batches(docs.select("doc_id", "text"), scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same documents with every reported span masked; overlapping spans become one mask.

    ``n_chars`` follows the new text where that column exists; a null text stays null.
    """
    names = docs.columns

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text in batch.column("text").to_pylist():
            if text:
                base, more = scan_text(text)
                end, parts = 0, []
                for s, _, e in sorted(base + more):
                    if s >= end:
                        parts += [text[end:s], mask]
                    end = max(end, e)
                text = "".join([*parts, text[end:]])
            texts.append(text)
        own = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            old = batch.column("n_chars")
            own["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
        return pa.RecordBatch.from_arrays([own.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return map_batches(docs, redact, docs.schema)
