"""License scans by canonical digest.

A text is reduced to a canonical form (case, punctuation, white space, copyright lines and equivalent
spellings do not matter) and the digest of the whole form is hash-joined to digests of known licences. The
same is done for every line, which finds notices that stand in a line of their own.

Defined cases: null and empty texts, and texts that are nothing but copyright lines, match nothing. Rows
that repeat are judged alike; a null doc_id keeps its row. Known licences of equal canonical form give the
first id. Long texts are compared whole, whatever their line breaks. Empty tables give an empty result or no match; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.session import cut

# Spellings that licence matching holds equal, as whole words.
EQUAL = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"), ("recognise", "recognize"), ("modelled", "modeled"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("analogue", "analog"), ("catalogue", "catalog"), ("centre", "center"), ("emphasise", "emphasize"), ("grey", "gray"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
# Public licence texts and notices (id, text).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("ISC", _ISC + _ISC_TAIL), ("ISC", "ISC License\n" + _ISC + _ISC_TAIL),
    ("0BSD", _0BSD + _ISC_TAIL), ("0BSD", "BSD Zero Clause License\n" + _0BSD + _ISC_TAIL), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("MIT", "SPDX-License-Identifier: MIT"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
)
#: A line that only tells whose rights they are.
#: The word alone does not make one: a wrapped licence text may begin a line with "copyright holders".
COPYRIGHT_LINE = r"(?im)^[\s#*/;-]*(?:(?:portions |parts )?copyright\b(?:[\s:,]*(?:\(c\)|©|by\b|the\b)|.*(?:19|20)[0-9][0-9]|[\s.:]*$)|\(c\)|©|all rights reserved\b|spdx-filecopyrighttext).*$"
_SIGNS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The form that licences are compared in; empty for null."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " ")
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _SIGNS, " "), F.lit(" "))
    for other, usual in EQUAL:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(text)


def digest(text: Column) -> Column:
    """MD5 of the canonical form; null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.md5(form))


def _opens(line: Column, table: DataFrame) -> Column:
    """Whether a line begins with a word that opens a known form, in any spelling; no other line can be one."""
    firsts = {r["w"] for r in table.select(F.substring_index("form", " ", 1).alias("w")).distinct().collect()}  # as few as the known texts
    firsts |= {other.split(" ")[0] for other, usual in EQUAL if usual.split(" ")[0] in firsts}
    word = F.lower(F.regexp_extract(line, r"[\p{L}\p{N}]+", 0))
    return F.substring_index(F.trim(F.regexp_replace(word, _SIGNS, " ")), " ", 1).isin(sorted(firsts))


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(known), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of a text that is a licence from end to end), notices (ids met by single lines, sorted, joined by commas; null if none)."""
    forms = known.select("license_id", canonical(F.col("text")).alias("form")).filter("form <> ''")
    forms = cut(forms.groupBy("form").agg(F.min("license_id").alias("license_id")), "licenses")
    table = forms.select("license_id", F.md5("form").alias("digest"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    lines = rows.select("doc_id", "text_hash", F.explode(F.split("text", "\n")).alias("line"))
    noted = lines.filter(_opens(F.col("line"), forms)).select("doc_id", "text_hash", digest(F.col("line")).alias("digest")).join(table, "digest")
    noted = noted.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = rows.select("doc_id", "text_hash", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    out = whole.join(noted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")), "left")
    return out.select("doc_id", "digest", "license_id", "notices")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan of ``documents`` as SQL."""

    def form(x: str) -> str:
        x = f"' ' || regexp_replace(lower(regexp_replace(coalesce({x}, ''), {_sql_text(COPYRIGHT_LINE)}, ' ', 'g')), {_sql_text(_SIGNS)}, ' ', 'g') || ' '"
        for other, usual in EQUAL:
            x = f"replace({x}, ' {other} ', ' {usual} ')"
        return f"nullif(trim({x}), '')"

    rows = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in known)
    return f"""WITH table_of AS (SELECT md5({form('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) v(i, t) GROUP BY 1),
lines AS (SELECT doc_id, md5(text) AS h, unnest(string_split(text, chr(10))) AS line FROM documents),
noted AS (SELECT doc_id, h, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN table_of ON md5({form('line')}) = digest GROUP BY 1, 2),
whole AS (SELECT doc_id, md5(text) AS h, md5({form('text')}) AS digest FROM documents)
SELECT w.doc_id, w.digest, t.license_id, n.notices FROM whole w LEFT JOIN table_of t ON w.digest = t.digest
LEFT JOIN noted n ON w.doc_id IS NOT DISTINCT FROM n.doc_id AND w.h = n.h"""
