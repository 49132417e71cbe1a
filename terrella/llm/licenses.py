"""License scans by canonical digest: entire texts against the digests of known licences.

A text is brought to canonical form (case, punctuation, copyright lines, equivalent spellings and white space no longer
differ), digested with SHA-256, and hash-joined to the digests of known licence texts, brought to the same form. All of it is
DataFrame functions. Letters and digits of every script count, so a text in another script never shrinks to a licence that it ends with. The table of
known licences is a parameter (`known_texts` reads a folder of licence files, such as the long ones that are not in the table here); its size is
checked before it is broadcast, and a larger one is joined by shuffling. A known text is known with each of its title lines and without.

Cases: a null text counts as empty; empty texts and texts of copyright lines only have an empty canonical form and
match nothing; repeated rows each give a row; equal known texts give their smallest licence id; an empty table gives no rows; other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known short licences and file headers. Public licence texts.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
#: Title lines that may stand above a known text. Fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Unlicense": ("The Unlicense",),
}
#: Spellings that count as one, the left written as the right. Fixed values.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("initialise", "initialize"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"), ("http", "https"))
#: Words that follow 'copyright' in the prose of licences and not in a notice.
PROSE = "notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interests?|disclaimers?|permissions?|protections?|treaty|treaties|rights?|acts?|infringements?|patents?|trademarks?|and|or|in|on|of|to|is|are|as|for|that|which|the software|the work"
#: A whole line that only names a holder; such lines do not count. With 'copyright' or © a year is not needed; '(c)' alone may number a clause.
COPYRIGHT_LINE = rf"(^|\n)[^a-z0-9\n]*(?:copyright(?![a-z0-9])(?![^a-z0-9\n]*(?:{PROSE})(?![a-z0-9]))[^\n]*[a-z0-9][^\n]*|©[^\n]*|\(c\)[^\n]*[0-9]{{4}}[^\n]*|all rights reserved[^a-z0-9\n]*)(?=\n|$)"
#: The pattern of the SQL, which has no look-ahead: it agrees on texts whose lines do not begin with 'copyright' or '(c)' in prose and whose notices have a year.
SQL_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)( [^\n]*[0-9]{4}[^\n]*|[^a-z0-9\n]*)"
KNOWN_ROWS_BROADCAST = 100_000


def canonical(text: Column) -> Column:
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.regexp_replace(words, f" {a} ", f" {b} ")
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_rows() -> list[tuple[str, str]]:
    """Ids and texts of the built-in table, titled and untitled."""
    return [(k, f"{title}\n\n{text}") for k, text in KNOWN.items() for title in ("", *TITLES.get(k, ()))]


def known_texts(spark: SparkSession, folder: str) -> DataFrame:
    """license_id and text of a folder of licence files, each named after its licence."""
    return spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("license_id"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null: no known licence) of every row. known: license_id, text."""
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(known_rows(), "license_id string, text string")
    table = known.select("license_id", F.col("text").alias("_text")).filter(canonical(F.col("_text")) != "").groupBy(digest(F.col("_text")).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    if known.limit(KNOWN_ROWS_BROADCAST + 1).count() <= KNOWN_ROWS_BROADCAST:
        table = F.broadcast(table)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("canonical_sha256")).join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql() -> str:
    def form(column: str) -> str:
        lines = f"regexp_replace(lower(coalesce({column}, '')), {_quoted(SQL_COPYRIGHT_LINE)}, chr(10), 'g')"
        words = f"' ' || trim(regexp_replace({lines}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            words = f"replace({words}, ' {a} ', ' {b} ')"
        return f"trim({words})"

    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known_rows())
    return f"""WITH known AS (SELECT sha256({form('t')}) AS h, min(id) AS license_id FROM (VALUES {rows}) AS k(id, t) GROUP BY 1),
d AS (SELECT doc_id, sha256({form('text')}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, known.license_id FROM d LEFT JOIN known ON known.h = d.canonical_sha256"""


def op3_license_scan(spark, sf_dir):
    from terrella.llm.common import table

    return scan(table(spark, sf_dir, "documents"))
