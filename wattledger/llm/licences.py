"""Licence scans by canonical digest.

A text is reduced to what matters: lower case, no copyright lines, words without punctuation, equivalent spellings made
one. Whole texts, and each of their lines, are then looked up by digest among known licence texts. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and short licence texts as published, by SPDX id.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]

#: Fixed values, in this order: spellings that count as equal, as (pattern on canonical words, replacement).
SPELLINGS = [
    ("(^|[ \\n])licen[cs]e", "\\1license"),
    ("(^|[ \\n])(sub|non|re) (license|commercial|infringement|distribut)", "\\1\\2\\3"),
    ("([a-z]{3})is(e|es|ed|er|ing|ation|ations)([ \\n]|\\z)", "\\1iz\\2\\3"),
    ("([a-z]{3})our(s|ed|ing|able|)([ \\n]|\\z)", "\\1or\\2\\3"),
    ("(^|[ \\n])acknowledgement", "\\1acknowledgment"),
    ("(^|[ \\n])owner(s|)([ \\n]|\\z)", "\\1holder\\2\\3"),
    ("(^|[ \\n])per cent([ \\n]|\\z)", "\\1percent\\2"),
    ("(^|[ \\n])version ([0-9])", "\\1v \\2"),
    ("(^|[ \\n])https([ \\n]|\\z)", "\\1http\\2"),
]
#: A line that begins like this, or holds no more than a reservation of rights, is a copyright line.
COPYRIGHT_LINE = "(?m)^[^\\p{L}\\p{N}\\n]*(?:(?:copyright|copr)[^\\p{L}\\p{N}\\n]+(?:\\(c\\)|©|<year>|\\[yyyy\\]|[0-9]{4})|\\(c\\)[^\\p{L}\\p{N}\\n]*[0-9]{4}|©|all rights reserved[^\\p{L}\\p{N}\\n]*$)[^\\n]*$"
NOT_WORD = "[^\\p{L}\\p{N}\\n]+"
#: Largest catalogue that is broadcast; a larger one is joined as the planner sees fit.
BROADCAST_TEXTS = 10_000


def canonical(text: Column) -> Column:
    """Canonical words, one space apart, lines kept apart by a line feed."""
    out = F.regexp_replace(F.lower(text), "\\r\\n?", "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, NOT_WORD, " ")
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return out


def joined(canon: Column) -> Column:
    """The canonical text as one line. Null for a text without a word."""
    return F.nullif(F.trim(F.regexp_replace(canon, "[ \\n]+", " ")), F.lit(""))


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``licence, digest``: one row per digest; of two licences with one canonical text the smaller id."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "licence string, text string")
    return rows.select("licence", F.sha2(joined(canonical(F.col("text"))), 256).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, line, digest, licence``: a row with line -1 for every document's whole text, licence null if unknown,
    and one for each line (from 0) that is a known licence text by itself.

    Only ``doc_id`` and ``text`` are read. A null, empty or wordless text has a null digest and no licence. Repeated
    rows each give their rows; an id may be null; an empty table gives no rows. A document of one line that is a known
    text gives both rows. The catalogue is a parameter, broadcast only while it has ``BROADCAST_TEXTS`` texts at most.
    """
    table = catalogue(docs.sparkSession, known)
    if len(known if known is not None else KNOWN) <= BROADCAST_TEXTS:
        table = F.broadcast(table)
    canon = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(canonical(F.col("text").cast("string")), F.lit("")).alias("canon"))
    lines = F.transform(F.split("canon", "\n"), lambda x, i: F.struct(i.alias("line"), F.nullif(F.trim(x), F.lit("")).alias("unit")))
    units = canon.select("doc_id", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("line"), joined(F.col("canon")).alias("unit"))),
        F.filter(lines, lambda x: x.unit.isNotNull()))).alias("u"))
    digests = units.select("doc_id", F.col("u.line").alias("line"), F.sha2("u.unit", 256).alias("digest"))
    return digests.join(table, "digest", "left").where("line = -1 or licence is not null").select("doc_id", "line", "digest", "licence")


def _sql_canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), '\\r\\n?', chr(10), 'g')"
    for pattern, new in [(COPYRIGHT_LINE, ""), (NOT_WORD, " "), *SPELLINGS]:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in KNOWN)


ORACLE = f"""
WITH known AS (
  SELECT min(licence) AS licence, sha256(unit) AS digest FROM (
    SELECT licence, trim(regexp_replace({_sql_canonical('text')}, '[ \\n]+', ' ', 'g')) AS unit
    FROM (VALUES {_sql_known()}) v(licence, text)) GROUP BY 2),
canon AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_sql_canonical('text')}, '') AS c FROM documents),
units AS (
  SELECT doc_id, -1 AS line, nullif(trim(regexp_replace(c, '[ \\n]+', ' ', 'g')), '') AS unit FROM canon
  UNION ALL
  SELECT doc_id, CAST(i - 1 AS INTEGER), nullif(trim(l[i]), '') FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(c, chr(10)) AS l FROM canon)))
SELECT doc_id, line, sha256(unit) AS digest, licence FROM units LEFT JOIN known ON sha256(unit) = digest
WHERE line = -1 OR licence IS NOT NULL
"""
