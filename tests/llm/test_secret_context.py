"""Secrets that stand more than once, in parts or over several lines."""

import random
import string

import pytest

from aerolytics.llm import secrets

SIGNS = string.ascii_letters + string.digits


def key(dice, n):
    return "".join(dice.choice(SIGNS) for _ in range(n - 2)) + "q7"


def novel(text):
    return [text[s:e] for s, _, e in secrets.scan_text(text)[1]]


@pytest.mark.parametrize("n", [16, 24, 40, 64])
def test_copies_of_a_key_near_each_other(spark, n):
    k = key(random.Random(n), n)
    two, three = f"credential {k} then Bearer {k} end", f"credential {k} then Bearer {k} and signature {k} end"
    far = f"credential {k} " + "word " * 200 + f"bearer {k} end"  # the edge of the surroundings cuts the other copy
    named = f"credential {k} and access_key={k} end"
    assert novel(two) == [k] * 2 and novel(three) == [k] * 3 and novel(far) == [k] * 2
    assert len(novel(named)) == 2 and all(x.endswith(k) for x in novel(named))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate((two, three, far, named))], "doc_id long, text string")
    assert not any(k in r.text for r in secrets.redact_secrets(docs).collect())
    assert [r.n_novel for r in sorted(secrets.find_secrets(docs).collect())] == [2, 3, 2, 2]


def test_parts_and_lines_past_the_reach():
    dice = random.Random(3)
    parts = [key(dice, n) for n in (36, 80, 43)]
    assert novel(f"Authorization: Bearer {'.'.join(parts)} ok") == parts
    assert novel(f"Bearer {parts[0]}.v2.{parts[1]}.getName") == parts[:2]
    lines = [key(dice, 64) for _ in range(12)] + ["Zk3+x=="]
    for name, head in (("RSA PRIVATE KEY", ""), ("PRIVATE KEY", ""), ("EC PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0\n\n")):
        for end in ("\n", "\r\n"):
            body = head.replace("\n", end) + end.join(lines)
            assert novel(f"a -----BEGIN {name}-----{end}{body}{end}-----END {name}-----{end}plain words") == lines
    escaped = "\\n".join(lines[:3])
    found = novel(f'"-----BEGIN PRIVATE KEY-----\\n{escaped}\\n-----END PRIVATE KEY-----"')
    assert len(found) == 3 and all(x.endswith(line) for x, line in zip(found, lines, strict=False))
    assert novel(f"secret\n{lines[0]}\n{lines[1]}\n{lines[2]}\nword\n{lines[3]}") == lines[:3]
    assert novel("private key of the house, api-key of the door\nword\nanother") == []


def test_words_with_blanks_and_hyphens():
    k = key(random.Random(4), 24)
    for word in ("api-key", "API key", "access-key", "private key", "apikey", "api_key"):
        assert novel(f"my {word} {k} here") == [k]


def test_candidates_that_a_base_span_only_touches():
    dice = random.Random(5)
    first, last = key(dice, 30) + "Q", "Z" + key(dice, 30)
    text = f"bearer {first}0123456789abcdef01234567{last} end"
    base, more = secrets.scan_text(text)
    assert [text[s:e] for s, _, e in more] == [f"{first}0123456789abcdef01234567{last}"] and [k for _, k, _ in base] == [2]
    whole = "token=" + key(dice, 30)
    assert secrets.scan_text(whole)[1] == []


def plain_novel(text):
    """All runs of key characters near a sensitive word, each with the bytes that it adds to a compressor of its own."""
    import re

    import zstandard

    words = [m.span() for m in secrets.SENSITIVE.finditer(text)]
    base, out = secrets.base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        s, e = m.span()
        if e - s < secrets.LEAST or not any(s <= b + secrets.REACH and e >= a - secrets.REACH for a, b in words):
            continue
        held = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda x: len(zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x.encode()))  # noqa: B023, E731
        around = secrets.surroundings(text, s, e)
        letters, digits = any(c.isalpha() for c in m[0]), any(c.isdigit() for c in m[0])
        word = m[0].isalpha() and (m[0][1:].islower() or m[0].isupper())
        if (size(around + m[0]) - size(around)) / len(m[0]) >= (1.1 if word else 0.6 if letters and digits else 0.8) and not all(any(x <= i < y for x, _, y in base) for i in range(s, e)):
            out.append(m.span())
    return out


def test_novel_spans_equal_brute_force():
    dice = random.Random(8)
    words = "the of token signature bearer cat internationalisation secret house api key your_token_here word 4761598977407687".split()
    for n in range(150):
        parts = [dice.choice(words) for _ in range(dice.randrange(60))]
        for _ in range(dice.randrange(4)):
            alphabet = dice.choice([SIGNS, string.ascii_letters, string.ascii_lowercase, "0123456789abcdef", string.digits])
            parts.insert(dice.randrange(len(parts) + 1), "".join(dice.choice(alphabet) for _ in range(dice.randrange(8, 50))))
        text = " ".join(parts)
        assert [(s, e) for s, _, e in secrets.scan_text(text)[1]] == plain_novel(text), text


def test_planted_secrets_are_found_and_prose_is_left_alone():
    dice = random.Random(9)
    prose = "it was a bright cold day in april and the clocks were striking thirteen while the secretariat considered the authorization of extraordinary correspondence".split()
    found = total = false = 0
    for n in range(200):
        alphabet = dice.choice([SIGNS, string.ascii_letters, SIGNS + "+/"])
        k = "".join(dice.choice(alphabet) for _ in range(dice.choice([12, 15, 24, 40])))
        before, after = (" ".join(dice.choice(prose) for _ in range(40)) for _ in range(2))
        text = f"{before} the signature is {k} {after}" if n % 2 else f"{before} {k} is the credential {after}"
        spans = novel(text)
        total, found, false = total + 1, found + (k in spans), false + len([x for x in spans if x != k])
    assert found >= 0.97 * total and false == 0
    assert novel("password reset key: QwErTyUiOpAsDfGhJkLzXcVb") == ["QwErTyUiOpAsDfGhJkLzXcVb"]
    assert novel("9fKq2ZpL7xVbT3m is the api key") == ["9fKq2ZpL7xVbT3m"]
    assert novel("authorization and internationalization of the token") == []


def test_secrets_of_an_empty_table_and_of_a_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert secrets.find_secrets(empty).count() == 0 and secrets.redact_secrets(empty).count() == 0
    k = key(random.Random(1), 30)
    long = "word token " * 100_000 + f"bearer {k} end"
    docs = spark.createDataFrame([(1, long, "x")], "doc_id long, text string, spans string")
    row = secrets.find_secrets(docs).head()
    assert row.n_novel == 1 and row.spans == f"novel:{len(long) - 34}:{len(long) - 4}"
