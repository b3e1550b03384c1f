"""URL filter: longest-match rules, then a weighted vocabulary counted by Aho-Corasick.

A url without a matching rule is rejected on one strict term or on several distinct soft
terms.  A term counts only where the characters before and after it are no letters or digits.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged by its whole string (null: empty, so allowed).  Repeated rows are judged one by one,
an empty table gives an empty result, and other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import ascii_lower, map_batches

# A small default vocabulary (a larger one comes from a table, see ``vocabulary_of``) and the rules.
STRICT_TERMS = ("adult", "casino", "porn", "spam-farm", "viagra")
SOFT_TERMS = ("ads", "bets", "bonus", "cheap", "free", "pills", "spam", "track", "win")
SOFT_HITS = 2
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Terms that a vocabulary from a table may have.
MAX_TERMS = 500_000
_built: dict["Vocabulary", ahocorasick.Automaton] = {}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Vocabulary:
    """Terms with their kind; a term in both lists is strict."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS

    def automaton(self) -> ahocorasick.Automaton:
        """Built once in each worker."""
        if self not in _built:
            _built.clear()
            _built[self] = self._automaton()
        return _built[self]

    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for kind, terms in (("soft", self.soft), ("strict", self.strict)):
            for term in terms:
                found.add_word(term, (term, kind))
        if len(found):
            found.make_automaton()
        return found


def vocabulary_of(terms: DataFrame) -> Vocabulary:
    """A vocabulary from a table (term, kind), kind being strict or soft; in lower case, empty terms and other kinds go.

    Every worker holds the whole automaton, so a table of over ``MAX_TERMS`` distinct terms is refused.
    """
    rows = terms.select(ascii_lower(F.col("term")).alias("term"), "kind").where("term <> '' and kind in ('strict', 'soft')").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return Vocabulary(*(tuple(sorted(r.term for r in rows if r.kind == kind)) for kind in ("strict", "soft")))


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms that stand between boundaries in a lower-case url."""
    strict: set[str] = set()
    soft: set[str] = set()
    if len(automaton):
        for end, (term, kind) in automaton.iter(url):
            start = end - len(term) + 1
            if (start == 0 or url[start - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
                (strict if kind == "strict" else soft).add(term)
    return strict, soft


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/?#`` in lower case; path from there up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = Vocabulary(), soft_hits: int = SOFT_HITS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = vocabulary.automaton()
        hits = [term_hits((u or "").translate(_LOWER), automaton) for u in batch.column("url").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([len(a) for a, _ in hits], pa.int32()), pa.array([len(b) for _, b in hits], pa.int32())],
            ["page_id", "url", "n_strict", "n_soft"],
        )

    kind = dict(pages.dtypes)["page_id"]
    counted = map_batches(pages.select("page_id", "url"), count, f"page_id {kind}, url string, n_strict int, n_soft int")
    host, path = host_and_path(F.col("url"))
    parts = counted.select("page_id", "n_strict", "n_soft", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft")


def oracle(vocabulary: Vocabulary = Vocabulary(), rules=RULES, soft_hits: int = SOFT_HITS) -> str:
    """DuckDB SQL for the same rows."""

    def hits(terms) -> str:
        return " + ".join(f"cast(regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])') as int)" for t in terms)

    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{{i}}}" for i, (h, p, _) in enumerate(sorted(rules, key=lambda r: -len(r[0] + r[1])))
    )
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with r as (select page_id, {lower.format("coalesce(url, '')")} as low,
                  case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, low, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from r),
c as (select *, {hits(vocabulary.strict)} as n_strict, {hits(vocabulary.soft)} as n_soft from p)
select page_id, host, path, case {cases.format(*(f"'{h}{q}'" for h, q, _ in order))} else null end as rule,
       case {cases.format(*(f"'{v}'" for _, _, v in order))} when n_strict > 0 or n_soft >= {soft_hits} then 'block' else 'allow' end as verdict,
       n_strict, n_soft
from c"""
