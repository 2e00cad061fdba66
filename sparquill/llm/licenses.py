"""License scans: whole texts, made canonical, are looked up by digest among known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import salted_join, staged, text_of

#: Spellings that count as the same word, from the public matching guidelines for licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software.\n\n" + _AS_IS
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_BSL = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
    "third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
    "solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND '
    "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WTFPL_HEAD = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\n"
_WTFPL = (
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\n"
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."
)
#: Known texts by licence. Short notices stand beside full texts; more rows can be given to scan().
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT-0", _MIT.replace(_MIT[_MIT.index("The above") - 2 : _MIT.index(_AS_IS)], "\n\n").replace(", subject to the following conditions:", ".")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + "1. " + _BSD_1 + "2. " + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "1. " + _BSD_1 + "2. " + _BSD_2 + "3. " + _BSD_3 + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("WTFPL", _WTFPL_HEAD + _WTFPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BSL),
]
_APART = r"[^\p{L}\p{N}]"
_NAME = rf"(?:[^.;:]|{_APART}(?:inc|ltd|llc|co|corp|jr|[a-z])\.)"
#: A line that holds only a copyright statement: "copyright", "©" or "(c)", then years and names up to its end; without a
#: year, "copyright" and a sign and a short name. A clause that begins with "(c)" or a sentence about copyright is none.
COPYRIGHT = (
    rf"^{_APART}*(?:(?:copyright|©|\(c\)){_APART}*)+(?:(?:19|20)[0-9][0-9]|<?\[?y(?:ear|yyy){_APART}){_NAME}*\.?{_APART}*$"
    rf"|^{_APART}*copyright{_APART}*(?:©|\(c\)){_NAME}{{0,60}}\.?{_APART}*$"
)
#: Distinct known texts up to which the list is broadcast (some 100 bytes each); longer lists are hash-joined.
MOST_KNOWN = 10_000


def canonical(line: Column) -> Column:
    """Lower case; all but letters and digits as single blanks; equivalent spellings as one; copyright lines empty."""
    low = F.lower(line)
    # Two blanks around each word, so that a spelling and its neighbour don't share one.
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " ", "  "), F.lit(" "))
    stems = "|".join(a.replace(" ", "  ") for a in sorted(SPELLINGS))
    spelt = plain
    for a, b in sorted(SPELLINGS.items()):
        spelt = F.replace(spelt, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    same = F.when(plain.rlike(f" (?:{stems}) "), spelt).otherwise(plain)
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(same, " +", " ")))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), canonical), lambda x: x != "")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Looks up every whole text, and every line of it, among known licence texts (columns license, text).

    Only DataFrame functions are used. The built-in list is small, is broadcast and nothing is shuffled. A caller's
    list of more than MOST_KNOWN distinct texts is hash-joined instead: by digest with the texts, and with the lines,
    whose hot digests are salted.

    Defined cases: null, empty and all-copyright texts have the empty canonical text and no licence; a digest that
    several licences share goes to the first by name; lines of any length are looked up; repeated rows give a row
    each; an empty table gives no rows. Other columns are ignored.

    Columns: doc_id, canonical_sha256, license_id (of the whole text, or null), notices (sorted ids of licences of
    which a line is the whole text), n_notice_lines.
    """
    spark = docs.sparkSession
    small = known is None
    known = spark.createDataFrame(KNOWN, "license string, text string") if known is None else known
    digests = known.select("license", F.sha2(F.array_join(_lines(text_of("text")), " "), 256).alias("canonical_sha256")).groupBy("canonical_sha256").agg(F.min("license").alias("license_id"))
    lines = docs.select(F.col(id_col).alias("doc_id"), _lines(text_of(text_col)).alias("lines"))
    texts = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"), "lines")
    out = ["doc_id", "canonical_sha256", "license_id", F.array_sort(F.array_distinct("hits")).alias("notices"), F.size("hits").cast("long").alias("n_notice_lines")]
    if small or digests.count() <= MOST_KNOWN:
        table = F.broadcast(digests.agg(F.map_from_entries(F.collect_list(F.struct("canonical_sha256", "license_id"))).alias("_known")))
        found = texts.join(F.broadcast(digests), "canonical_sha256", "left").crossJoin(table)
        hits = F.filter(F.transform("lines", lambda x: F.try_element_at("_known", F.sha2(x, 256))), lambda x: x.isNotNull())
        return found.select("doc_id", "canonical_sha256", "license_id", hits.alias("hits")).select(*out)
    digests = staged(digests, "licenses")
    rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "canonical_sha256", F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines")), "license-rows")
    looked = rows.select("row", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("canonical_sha256").alias("key"))), F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("key"))))).alias("k")).select("row", "k.whole", F.col("k.key").alias("canonical_sha256"))
    sizes = looked.groupBy("canonical_sha256").agg(F.count(F.lit(1)).alias("n"))
    hits = salted_join(looked, digests.join(sizes, "canonical_sha256"), ["canonical_sha256"], "n", F.col("row"))
    mine = hits.groupBy("row").agg(F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"), F.collect_list(F.when(~F.col("whole"), F.col("license_id"))).alias("hits"))
    return rows.drop("lines").join(mine, "row", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>"))).select(*out)


def sql() -> str:
    """The scan in DuckDB's SQL."""
    spelt = "plain"
    for a, b in sorted(SPELLINGS.items()):
        spelt = f"replace({spelt}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(a)}, {quoted(t)})" for a, t in KNOWN)
    return f"""
WITH known(license, t) AS (VALUES {rows}),
raw AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, NULL AS license, coalesce(text, '') AS t FROM documents
        UNION ALL SELECT 'k', row_number() OVER (), NULL, license, t FROM known),
l AS (SELECT kind, r, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT kind, r, string_split(t, chr(10)) AS x FROM raw)),
p AS (SELECT kind, r, i, line, ' ' || replace(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ', '  ') || ' ' AS plain FROM l WHERE NOT regexp_matches(lower(line), '{COPYRIGHT}')),
c AS (SELECT kind, r, i, trim(regexp_replace({spelt}, ' +', ' ', 'g'), ' ') AS c FROM p),
n AS (SELECT * FROM c WHERE c <> ''),
whole AS (SELECT kind, r, sha256(coalesce(string_agg(c, ' ' ORDER BY i), '')) AS canonical_sha256 FROM raw LEFT JOIN n USING (kind, r) GROUP BY kind, r),
digests AS (SELECT canonical_sha256, min(license) AS license_id FROM whole JOIN raw USING (kind, r) WHERE kind = 'k' GROUP BY canonical_sha256),
hits AS (SELECT r, license_id FROM n JOIN digests ON sha256(c) = canonical_sha256 WHERE kind = 'd'),
notices AS (SELECT r, list_sort(list(DISTINCT license_id)) AS notices, count(*) AS n_notice_lines FROM hits GROUP BY r)
SELECT doc_id, canonical_sha256, license_id, coalesce(notices, []) AS notices, coalesce(n_notice_lines, 0) AS n_notice_lines
FROM raw JOIN whole USING (kind, r) LEFT JOIN digests USING (canonical_sha256) LEFT JOIN notices USING (r) WHERE kind = 'd'
"""
