"""License scan: canonical digests of entire texts, joined to those of known licences.

A text is lower-cased, its copyright lines go, equivalent spellings become one, and all but
letters and digits become single blanks.  The digest of what is left is joined to the digests
of known licences: once for the entire text of a document, and once for each of its lines, as
notices stand on a line of their own.

Edge cases: a null text is an empty one; an empty canonical text matches nothing; repeated rows
are reported one by one; a licence that matches under two names is reported under the smallest.
A text of any length is one row of lines; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.operators.attach import small

# Known texts.  The second value tells entire licences from notices of one line.
KNOWN_TEXTS = (
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", "text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Titles under which the texts above are usually published.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"),
}
KNOWN_TEXTS += tuple((i, "text", f"{title}\n\n{text}") for i, kind, text in KNOWN_TEXTS if kind == "text" for title in TITLES[i])
KNOWN_TEXTS += (("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),)
# A pattern for lines that state a copyright, and equivalent spellings in the order of their use.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©]*(copyright|\(c\)|©|all rights reserved)"
SPELLINGS = (
    (r"licenc", "licens"),
    (r"https://", "http://"),
    (r"non-commercial", "noncommercial"),
    (r"non-infringement", "noninfringement"),
    (r"sub-licens", "sublicens"),
    (r"acknowledgement", "acknowledgment"),
    (r"judgement", "judgment"),
    (r"whilst", "while"),
    (r"favour", "favor"),
    (r"behaviour", "behavior"),
    (r"authoris", "authoriz"),
    (r"organis", "organiz"),
    (r"recognis", "recogniz"),
)


def published_texts() -> tuple[tuple[str, str, str], ...]:
    """Entire texts as published, from files named by their ids; copyright lines go, the others become one line, which keeps the digest."""
    folder, states = files("aerolytics.llm").joinpath("license_texts"), re.compile(COPYRIGHT_LINE.replace(r"[^\p{L}\p{N}©]", r"(?:[^\w©]|_)"))
    if not folder.is_dir():  # in an executor's copy of the sources, which scans nothing by itself
        return ()
    found = sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in folder.iterdir() if x.name.endswith(".txt"))
    return tuple((i, "text", " ".join(x for x in re.split("[\n\r]", text) if not states.match(x.lower()))) for i, text in found)


KNOWN_TEXTS += published_texts()


def canonical_line(line: Column) -> Column:
    """One line in canonical form; empty if it states a copyright."""
    low = F.lower(line)
    text = low
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(text)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n\r]"), canonical_line), lambda x: x != "")


def known_digests(spark, known: Iterable[tuple[str, str, str]] = KNOWN_TEXTS) -> DataFrame:
    """(digest, kind, license_id) of the known texts; as many rows at most."""
    rows = spark.createDataFrame(list(known), "license_id string, kind string, known string")
    digest = F.sha2(F.array_join(canonical_lines(F.col("known")), " ").cast("binary"), 256)
    return rows.groupBy(digest.alias("digest"), "kind").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license_id (entire text; else null), n_notices, notices (distinct ids).

    ``known`` is (digest, kind, license_id), by default that of ``known_digests``.  It is broadcast below a size
    that is checked.  Lines are put into canonical form once: a document's entire text and its lines become
    rows of digests, those that match are kept beside the one of the text, and rows of one document meet again in
    an aggregate; equal rows of a document are counted and come back as many.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    lines = docs.select("doc_id", F.xxhash64("text").alias("_hash"), canonical_lines(F.col("text")).alias("_lines"))
    whole = F.struct(F.lit(-1).alias("at"), F.lit("text").alias("kind"), digest(F.array_join("_lines", " ")).alias("digest"))
    each = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), F.lit("notice").alias("kind"), digest(x).alias("digest")))
    rows = lines.select("doc_id", "_hash", F.explode(F.concat(F.array(whole), each)).alias("r")).select("doc_id", "_hash", "r.*")
    table, fits = small(known.select("digest", "kind", "license_id"), limit)
    met = rows.join(F.broadcast(table) if fits else table, ["digest", "kind"], "left").where("at = -1 or license_id is not null")
    notice = F.when(F.col("at") >= 0, F.col("license_id"))
    found = met.groupBy("doc_id", "_hash").agg(
        F.max(F.when(F.col("at") == -1, F.col("digest"))).alias("digest"), F.min(F.when(F.col("at") == -1, F.col("license_id"))).alias("license_id"), F.count_if(F.col("at") == -1).alias("_copies"),
        F.countDistinct(F.when(notice.isNotNull(), F.col("at"))).alias("n_notices"), F.array_join(F.sort_array(F.collect_set(notice)), ",").alias("notices"),
    )
    return found.select("doc_id", "digest", "license_id", "n_notices", "notices", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("col")


def oracle(known: Iterable[tuple[str, str, str]] = KNOWN_TEXTS) -> str:
    """DuckDB SQL for the same rows."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    line = "lower(l)"
    for old, new in SPELLINGS:
        line = f"replace({line}, '{old}', '{new}')"
    line = rf"case when regexp_matches(lower(l), '{COPYRIGHT_LINE}') then '' else trim(regexp_replace({line}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) end"
    lines = lambda body: f"list_filter(list_transform(regexp_split_to_array(coalesce({body}, ''), '[\\n\\r]'), lambda l: {line}), lambda x: x <> '')"
    return f"""
with k as (select sha256(array_to_string({lines("body")}, ' ')) as digest, kind, min(license_id) as license_id
           from (values {", ".join(f"({quote(i)}, {quote(k)}, {quote(t)})" for i, k, t in known)}) v(license_id, kind, body) group by 1, 2),
d as (select doc_id, row_number() over () as r, {lines("text")} as ls from documents),
n as (select r, count(*) as n_notices, string_agg(distinct license_id, ',' order by license_id) as notices
      from (select r, unnest(ls) as l from d) e join k on k.kind = 'notice' and k.digest = sha256(l) group by r),
w as (select doc_id, r, sha256(coalesce(array_to_string(ls, ' '), '')) as digest from d)
select doc_id, w.digest, k.license_id, coalesce(n_notices, 0) as n_notices, coalesce(notices, '') as notices
from w left join k on k.kind = 'text' and k.digest = w.digest left join n on n.r = w.r"""
