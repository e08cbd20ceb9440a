"""Licence scans by canonical digests, with built-in functions only.

Text is made canonical: lower case, copyright lines and list marks dropped, equivalent spellings made one, anything
but letters and digits read as one space. The SHA-256 of a whole canonical text is hash-joined to the digests of
known licence texts, with and without their title and their appendix. Parts of a text are looked up by the digests of
their canonical form in the same way: each of its paragraphs and each of its lines that names a licence, permission,
redistribution or warranty, whole, among the digests of such paragraphs of the known texts (those that one licence
alone has) and of one-line notices. That table is a constant of the plan, so texts are neither exploded nor shuffled.

license is that of the whole text, else the first by name of those of its parts. A document is restricted if one of
these is on the restricted list; kept is false then.

Null and blank texts have the digest of the empty text and match nothing. Empty tables give empty ones; repeated
rows are judged alike; a digest of several licences counts as the first by name; texts of any length are read whole;
other columns pass through whatever their names. The table of known texts is a parameter; it is broadcast while it is
small, so documents stay where they are; beyond, the join shuffles by digest.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, only, small, spare, written

#: Public licence texts (copyright lines are dropped by the canonical form).
PERMISSION_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n"
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": MIT_GRANT + "\n\n" + PERMISSION_WARRANTY,
    "ISC": ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_WARRANTY,
    "0BSD": ISC_GRANT + ".\n\n" + ISC_WARRANTY,
    "BSD-2-Clause": BSD_HEAD + BSD_WARRANTY,
    "BSD-3-Clause": BSD_HEAD + BSD_NAME + BSD_WARRANTY,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Titles of the texts above.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}
#: Where a published text's appendix begins, or the line that ends its terms.
APPENDIX = r"(?m)^[ \t]*(?:END OF TERMS AND CONDITIONS|APPENDIX: |How to Apply These Terms|Exhibit A - )"
#: One-line notices.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
}
RESTRICTED = ("GPL-3.0", "CC-BY-NC-4.0")
#: Spellings read as one.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"))


#: Lines that name a holder or years; marks at the start of list items; what separates words.
HOLDER = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?: ?\(c\))? ?(?:©|\(c\)|[0-9])|©|\(c\) ?[0-9]|all rights reserved)[^\n]*$"
MARK, APART, HINT = r"(?m)^[ \t\n\r]*(?:[0-9]{1,2}|[a-z])[.)][ \t\n\r]", r"[^\p{L}\p{N}]+", "(?i)licen[sc]e|released under|permission|redistribut|warrant"
BLANK, SECTION_WORDS = r"\n[ \t\r]*\n", 12


#: Lines that name a holder without a sign or year after the word; not those that go on as a sentence of a licence.
NAMED_START = r"^[^\p{L}\p{N}\n]*copyright:? +"
NAMED_GOES_ON = r"(?:notice|holder|owner|laws?\b|licen[sc]e|interest|disclaim|treat|protection|statement|permission|material|rights?\b|works?\b|means|(?:and|or|on|in|to|of|for|as|is|are|was|may|that|which|can|under|does|will|shall|has|it|this|if|not|with|from|at|an?)\b|the above)"
NAMED_HOLDER = r"[\p{L}\p{N}<\[{(\"']"
NAMED = f"(?m){NAMED_START}(?!{NAMED_GOES_ON}){NAMED_HOLDER}[^\\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (HOLDER, NAMED, MARK):
        t = F.regexp_replace(t, pattern.replace("(?m)", "(?md)"), " ")  # only \n ends a line
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, APART, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_text(text: str) -> str:
    """The same for a string, for known texts."""
    t = text.lower()
    for pattern in (HOLDER, NAMED, MARK):
        t = regex.sub(pattern, " ", t)
    t = f" {regex.sub(APART, ' ', t).strip(' ')} "
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return t.strip(" ")


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


@lru_cache(1)
def published() -> tuple[tuple[str, str], ...]:
    """(license, text) of all known texts: those above and the files beside this module, with and without title and appendix."""
    forms = {(k, t) for k, v in TEXTS.items() for t in (v, *(title + "\n\n" + v for title in TITLES[k]))}
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8").strip("\n")
        ends = [len(text)] + [x for m in re.finditer(APPENDIX, text) for x in (m.start(), m.end())[: 1 + m.group().strip().startswith("END")]]
        blocks = [0] + [m.end() for m in re.finditer(r"\n[ \t]*\n", text)][: 2 if path.stem.startswith("CC") else 1]
        for form in {text[a:b] for a in blocks for b in ends}:
            forms |= {(path.stem, form), (path.stem, form.replace("https://", "http://")), (path.stem, form.replace("http://", "https://"))}
    return tuple(sorted(forms))


@lru_cache(1)
def known_parts() -> dict[str, str]:
    """Digest to licence for paragraphs of SECTION_WORDS words or more that one licence alone has, and for notices."""
    held: dict[str, set[str]] = defaultdict(set)
    for name, text in published():
        for part in re.split(BLANK, text):
            if re.search(HINT, part) and len(canonical_text(part).split(" ")) >= SECTION_WORDS:
                held[digest_of(part)].add(name)
    for name, lines in NOTICES.items():
        for line in lines:
            held[digest_of(line)].add(name)
    return {d: min(names) for d, names in sorted(held.items()) if len(names) == 1}


def known_texts(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of known texts."""
    rows = published() if texts is None else tuple(texts.items())
    return spark.createDataFrame(pa.table({"digest": pa.array([digest_of(t) for _, t in rows], pa.string()), "license": pa.array([k for k, _ in rows], pa.string())}))


def scanned(docs: DataFrame, text_col: str = "text", known: DataFrame | None = None, parts: dict[str, str] | None = None, restricted: tuple = RESTRICTED) -> tuple[DataFrame, dict[str, str]]:
    """docs with canonical_sha256, license, notices (sorted array: licences of parts) and kept, and the names of these.

    known: (digest, license) of whole texts; parts: digest to licence, a bounded table that becomes part of the plan.
    """
    spark = docs.sparkSession
    keys = ("canonical_sha256", "license", "notices", "kept")
    digest, lic, found, kept, whole, key = spare(docs, *keys, "whole_license", "known_digest")
    known = (known_texts(spark) if known is None else known).groupBy("digest").agg(F.min("license").alias("license"))
    known = written(known, "licences").toDF(key, whole)
    text = F.coalesce(col(text_col), F.lit(""))
    d = docs.withColumn(digest, F.sha2(canonical(text), 256))
    pieces = F.filter(F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLANK))), lambda x: x.rlike(HINT))
    table = F.create_map(*[F.lit(x) for pair in (known_parts() if parts is None else parts).items() for x in pair]).cast("map<string,string>")
    names = F.filter(F.transform(pieces, lambda x: F.element_at(table, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    d = d.withColumn(found, F.when(text.rlike(HINT), F.array_sort(F.array_distinct(names))).otherwise(F.expr("cast(array() as array<string>)")))
    d = d.join(small(known), F.col(digest) == F.col(key), "left").drop(key)
    no = F.array(*map(F.lit, restricted))
    bad = F.arrays_overlap(F.col(found), no) | F.coalesce(F.array_contains(no, F.col(whole)), F.lit(False))
    d = d.withColumns({lic: F.coalesce(F.col(whole), F.get(F.col(found), F.lit(0))), kept: ~F.coalesce(bad, F.lit(False))}).drop(whole)
    return d, dict(zip(keys, (digest, lic, found, kept)))


def permitted(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept; their columns as they were."""
    d, name = scanned(docs, text_col, **options)
    return only(d, name["kept"], docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical_sha256, license, notices as one string, kept)."""
    d, name = scanned(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    return d.select(F.col("id").alias(id_col), F.col(name["canonical_sha256"]).alias("canonical_sha256"), F.col(name["license"]).alias("license"), F.array_join(name["notices"], ",").alias("notices"), F.col(name["kept"]).alias("kept"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(HOLDER)}, ' ', 'g')"
    named = f"regexp_matches(y, {_quoted(NAMED_START + NAMED_HOLDER)}) AND NOT regexp_matches(y, {_quoted(NAMED_START + NAMED_GOES_ON)})"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda y: CASE WHEN {named} THEN ' ' ELSE y END), chr(10))"
    t = f"' ' || trim(regexp_replace(regexp_replace({t}, {_quoted(MARK)}, ' ', 'g'), {_quoted(APART)}, ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, {_quoted(f' {a} ')}, {_quoted(f' {b} ')})"
    return f"trim({t})"


def sql() -> str:
    """DuckDB's form of report() over `documents`, with the digests of the known texts and parts."""
    known = {}
    for name, text in published():
        known.setdefault(digest_of(text), name)  # by name
    values = lambda of: ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(of.items()))
    no = ", ".join(map(_quoted, RESTRICTED))
    return f"""
WITH known(digest, license) AS (VALUES {values(known)}), parts(digest, license) AS (VALUES {values(known_parts())}),
d AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_canonical_sql("text")}) AS canonical_sha256 FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_filter(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, {_quoted(BLANK)})), lambda x: regexp_matches(x, {_quoted(HINT)}))) AS part FROM d),
n AS (SELECT u.doc_id, list_sort(list(DISTINCT p.license)) AS names FROM u JOIN parts p ON p.digest = sha256({_canonical_sql("u.part")}) GROUP BY u.doc_id)
SELECT d.doc_id, d.canonical_sha256, coalesce(k.license, n.names[1]) AS license, coalesce(array_to_string(n.names, ','), '') AS notices,
  NOT (coalesce(list_has_any(n.names, [{no}]), false) OR coalesce(k.license IN ({no}), false)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN known k ON k.digest = d.canonical_sha256
"""
