"""Licence scans by canonical digests.

A text is brought to a canonical form, in which case, punctuation, copyright lines and equivalent spellings no longer
tell texts apart, and its digest is looked up among those of known licences: once for the entire text, and once for
each line, since documents also carry one-line notices.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spare

# Equivalent spellings, after lower-casing.
SPELLINGS = [
    (r"licence", "license"), (r"licencing", "licensing"), (r"sub-licens", "sublicens"), (r"organisation", "organization"), (r"authoris", "authoriz"),
    (r"analogue", "analog"), (r"favour", "favor"), (r"judgement", "judgment"), (r"non-commercial", "noncommercial"), (r"web site", "website"),
    (r"copy-?left", "copyleft"), (r"https://", "http://"), (r"[“”„«»]", "\""), (r"[‘’`]", "'"), (r"[–—‒]", "-"),
]
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# Texts of known licences, and of notices that name one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = [
    ("MIT", "MIT License\n" + _MIT), ("MIT", _MIT), ("ISC", "ISC License\n" + _ISC), ("ISC", _ISC),
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END])),
    # The public texts of longer licences, a file each.
    *[(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))],
]
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that has any words left; none for a null text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, a, b)
    out = F.regexp_replace(out, NOT_WORD, " ")
    return F.filter(F.transform(F.split(out, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return F.array_join(canonical_lines(text), " ")


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``digest, size, license`` of the given texts, one row a digest; the first of two licences with one digest wins.

    ``size`` is the canonical text's length. Texts without words have the digest of the empty text; no texts, no rows.
    """
    rows = [(i, a, b) for i, (a, b) in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, license string, text string").select("i", "license", canonical(F.col("text")).alias("text"))
    return got.groupBy(F.md5("text").alias("digest"), F.length("text").alias("size")).agg(F.min_by("license", "i").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, notices: DataFrame, *, text_col: str = "text", max_notices: int = 10_000) -> DataFrame:
    """``docs`` with ``text_digest``, ``license`` and ``notices`` (columns of these names replaced).

    ``licenses`` and ``notices`` are as ``known`` makes them. ``license`` is that of the entire text, or null; it comes
    from a join of digests. ``notices`` are the distinct licences of its lines, sorted; lines of any length are looked
    up, if some notice is as long. Null, empty and blank texts have the digest of the empty text, no licence and no
    notices. Every row stays, repeated ones too; an empty table stays empty. More than ``max_notices`` notice digests
    raise ValueError, since they go to every task.
    """
    rows = notices.orderBy("digest").limit(max_notices + 1).collect()
    if len(rows) > max_notices:
        raise ValueError(f"more than {max_notices} notices")
    of_line = F.from_json(F.lit(json.dumps({r["digest"]: r["license"] for r in rows})), "map<string,string>")
    sizes = sorted({r["size"] for r in rows})
    lines, digest = spare(docs, "lines", "digest")
    out = docs.drop("text_digest", "license", "notices").withColumn(lines, canonical_lines(F.col(text_col)))
    asked = F.filter(lines, lambda line: F.length(line).isin(sizes))
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform(asked, lambda line: F.element_at(of_line, F.md5(line))))))
    out = out.withColumn("text_digest", F.md5(F.array_join(lines, " "))).withColumn("notices", named).drop(lines)
    whole = licenses.select(F.col("digest").alias(digest), "license").where(F.col(digest) != F.md5(F.lit("")))
    return out.join(whole, F.col("text_digest") == F.col(digest), "left").drop(digest)
