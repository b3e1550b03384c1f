"""Language identification by rank-order n-gram profiles (out-of-place distance).

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, words
padded by a blank) over all training documents, counted without a sample or cap.  A document's
own most frequent n-grams are compared to each profile: an n-gram costs the difference of its
two ranks, or the profile's length where the profile lacks it.  The least sum wins.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if nothing was learned.  Rows with null lang teach nothing but are judged.  Ties in counts are
broken by the n-gram, ties in distance by the language's name.  Repeated rows count repeatedly.
What reaches the driver and the tasks is ``PROFILE`` n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolytics.llm.common import doc_crc, free_names, map_batches, own_columns, schema_with, ship, small_batches

PROFILE = 400
UNDETERMINED = "und"
#: Closeness below which a text counts as no language that was learned.  Over all documents of 0.1 the least score is 0.40 and
#: that of texts under 20 letters 0.48; random letters give up to 0.28 (30 signs) or 0.20 (200 and more), other scripts 0.
LEAST_SCORE = 0.3
_BLANK, _SHIFT = 1, 21
#: Letters that are turned into n-grams at once, and counts kept by a task before it hands them on.
_STEP, _HELD = 400_000, 1_000_000

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _letters[0]


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers over 1, with one blank (1) before, between and after words; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    codes = np.where(is_letter, codes + 2, _BLANK).astype(np.uint64)
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))
    codes = codes[keep]
    return np.concatenate(([_BLANK], codes, [_BLANK] if codes[-1] != _BLANK else [])).astype(np.uint64)


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 signs as ascending numbers, and their counts; a blank is never inside or alone."""
    total: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))
    for at in range(0, max(len(codes) - 1, 0), _STEP):
        own = codes[at : at + _STEP + 2]  # n-grams that begin in this step
        a, b = own[:-1], own[1:]
        a, b = a[:_STEP], b[:_STEP]
        c = own[2:][:_STEP]
        solid = a != _BLANK
        two = (a << np.uint64(2 * _SHIFT)) | (b << np.uint64(_SHIFT))
        inner = b[: len(c)] != _BLANK
        three = two[: len(c)][inner] | c[inner]
        found = np.unique(np.concatenate((a[solid] << np.uint64(2 * _SHIFT), two, three)), return_counts=True)
        total = found if not len(total[0]) else added([total, found])
    return total


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, where, np.concatenate([n for _, n in parts]))
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranked n-grams of each language, looked up together."""

    def __init__(self, grams: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(grams)
        self.keys = np.unique(np.array([g for x in grams.values() for g in x], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(grams[lang], np.uint64))] = np.arange(len(grams[lang]))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, closeness (1 less the distance by the largest distance) and lead over the second."""
        codes = letter_codes(text or "")
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0, 0.0
        own = ranked(*gram_counts(codes), self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[:, np.where(self.keys[at] == own, at, len(self.keys))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1) / (self.size * len(own))
        best = int(np.argmin(apart))
        second = np.min(np.delete(apart, best)) if len(apart) > 1 else 1.0
        return self.langs[best], float(1 - apart[best]), float(second - apart[best])


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from every row of ``docs`` (text, lang) whose lang isn't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            parts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(text)
            for lang, texts in parts.items():
                found = gram_counts(letter_codes("\n".join(texts)))
                held[lang] = added([held[lang], found]) if lang in held else found
            if sum(len(k) for k, _ in held.values()) > _HELD:
                yield from rows()
        yield from rows()

    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    counts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= size)
    grams: dict[str, dict[int, int]] = {}
    for row in top.toLocalIterator():  # PROFILE rows for each language
        grams.setdefault(row.lang, {})[row.rank] = row.gram
    return Profiles({lang: [x[r] for r in sorted(x)] for lang, x in grams.items()}, size)


def in_training(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: all but the fold with remainder 2 of 4."""
    return docs.where(F.coalesce(doc_crc(), F.lit(0)) % 4 != 2)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents and three more columns, the last: ``_lang``, ``_score`` and ``_lead`` (with underscores after them where taken)."""
    names, more = docs.columns, free_names(docs, "_lang", "_score", "_lead")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.judge(x) for x in batch.column("text").to_pylist()]
        langs, scores, leads = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64())], [*names, *more])

    return map_batches(docs, judge, schema_with(docs, **dict(zip(more, ("string", "double", "double"), strict=True))))


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, lead."""
    found = identify(docs.select("doc_id", "text"), learn_profiles(in_training(docs)))
    return found.select("doc_id", (F.coalesce(doc_crc(), F.lit(0)) % 4 == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_lead").alias("lead"))


def keep_known_languages(docs: DataFrame, least: float = LEAST_SCORE, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The documents whose text is close to a learned language, or to one of those ``wanted``, with their own columns.

    Texts without letters go, and so do those with a score below ``least``: random letters, encoded data, unknown scripts.
    Where nothing was learned, as no row has a lang, no text can be judged and all with a letter stay.
    """
    profiles = learn_profiles(in_training(docs))
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, profiles)
    lang, score, _ = own_columns(found)[-3:]
    fits = (lang != UNDETERMINED) & (score >= least)
    return found.where(fits if wanted is None else fits & lang.isin(*wanted)).select(*own_columns(docs))
