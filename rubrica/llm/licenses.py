"""License scans by canonical digest lookup.

DataFrame and SQL functions only. A text's canonical form is in lower case,
without copyright lines, with one spelling for equivalent words and one space
for each run of other characters; its SHA-256 is joined to the digests of
known licences. The same lookup is made for each line, since licence notices
are often one line of a document.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as whole words of canonical lines: (from, to). Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("wilfull", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known licences: (identifier, text). Several texts may have one identifier. Fixed values.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("\n\nTHIS", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS")


def _bsd_forms(name: str, text: str, heading: str) -> list[tuple[str, str]]:
    """A text with numbers or bullets, each with and without its heading."""
    bare = text.replace("\n\n1. ", "\n\n* ").replace("\n\n2. ", "\n\n* ").replace("\n\n3. ", "\n\n* ")
    return [(name, head + t) for t in (text, bare) for head in ("", heading + "\n\n")]


#: Entire licences with a file in license_texts.
FILED = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");'
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at http://mozilla.org/MPL/2.0/.")


def more_known() -> list[tuple[str, str]]:
    """Further licences and notices, in the form of KNOWN."""
    texts = {i: files("rubrica.llm").joinpath(f"license_texts/{i}.txt").read_text("utf-8") for i in FILED}
    terms, end = texts["Apache-2.0"], "END OF TERMS AND CONDITIONS"
    out = [*texts.items(), ("Apache-2.0", terms[: terms.index(end) + len(end)]), ("Apache-2.0", terms[: terms.index(end)])]
    out += _bsd_forms("BSD-2-Clause", _BSD2, "BSD 2-Clause License") + _bsd_forms("BSD-3-Clause", _BSD3, "BSD 3-Clause License")
    # the usual notices, as one line and by the line of their usual wrapping that names the licence
    out += [("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + " you may not use this file except in compliance with the License."), ("Apache-2.0", terms[terms.index(_APACHE.split("(")[0]) :])]
    out += [("Apache-2.0", "Licensed under the Apache License 2.0."), ("MPL-2.0", " ".join(_MPL)), ("MPL-2.0", _MPL[1])]
    out += [(i, f"SPDX-License-Identifier: {i}") for i in ("MPL-2.0", "Unlicense", "ISC", "0BSD", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")]
    for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"):
        out += [(i, f"SPDX-License-Identifier: {i}{end}") for end in ("", "-only", "-or-later", "+")]
    return out


#: A line that only says whose the rights are.
COPYRIGHT = r"^(copyright|c) (c |[0-9])[^\n]*$|^all rights reserved$"
#: Known digests up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


#: Spellings of single words, and of phrases.
_WORDS = {a: b for a, b in SPELLINGS if " " not in a}
_PHRASES = [(a, b) for a, b in SPELLINGS if " " in a]


def spelled(line: Column) -> Column:
    """A canonical line in one spelling: each word looked up by itself, then phrases. Doing it again changes nothing."""
    table = F.create_map(*(F.lit(x) for pair in _WORDS.items() for x in pair))
    out = F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(table[w], w)), " ")
    for a, b in _PHRASES:
        out = F.regexp_replace(out, f"(?<![^ ]){a}(?![^ ])", b)
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty and copyright lines.

    Spellings are looked up only in lines that contain one of them.
    """
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit("c"))
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))
    words = "|".join(a for a, _ in SPELLINGS)
    return F.transform(lines, lambda x: F.when(x.rlike(f"(?<![^ ])({words})(?![^ ])"), spelled(x)).otherwise(x))


def digests_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " ").cast("binary"), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, license_id) of (identifier, text) pairs, by default KNOWN and more_known(); of identifiers with one canonical text, the first by name."""
    rows = spark.createDataFrame(list(KNOWN) + more_known() if known is None else list(known), "license_id string, text string")
    return rows.select(digests_of(canonical_lines(F.col("text"))).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, license_id, notices) of each row.

    license_id is that of the licence whose canonical text the whole text has
    (else null); notices lists, in order and comma-separated, the licences
    whose canonical text a line of it has (none: empty). A null or empty text
    has the digest of no characters. Texts of any length are read whole. Ids
    may be null or repeat: each row is scanned by itself. ``known`` is a
    (digest, license_id) table of unique digests. Other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    if known is None:
        known = known_digests(docs.sparkSession)
    known = known.select(F.col("digest").alias("d"), "license_id")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    lines = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), digests_of(F.col("lines")).alias("digest"))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x.cast("binary"), 256).alias("digest")))
    units = lines.select("id", "row", F.explode(F.concat(F.array(whole), each)).alias("u")).select("id", "row", "u.whole", "u.digest")
    found = units.join(known, units["digest"] == F.col("d"), "left").where(F.col("whole") | F.col("license_id").isNotNull())
    by_row = found.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    )
    return by_row.select(F.col("id").alias(id_col), "text_digest", "license_id", "notices")
