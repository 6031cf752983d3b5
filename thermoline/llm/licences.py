"""Licence scans: canonical texts looked up by digest among known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.llm.common import sheltered

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Identifiers and public texts of licences, and short notices that name one.
KNOWN = [
    ("MIT", (
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy "
        'of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("ISC", (
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any "
        "purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. " + _AS_IS)),
    ("0BSD", (
        "Zero-Clause BSD. Permission to use, copy, modify, and/or distribute this software for any "
        "purpose with or without fee is hereby granted. " + _AS_IS)),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may "
        "be used to endorse or promote products derived from this software without specific prior "
        "written permission. " + _BSD_END)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Spellings that count as equal, in canonical form.
EQUAL = [("licence", "license"), ("sub license", "sublicense"),
         ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
         ("per cent", "percent")]

MADE = ["whole_licence", "n_notices", "notices"]


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form, blank ones left out: lower case, runs of other than
    letters and digits as one blank, lines that state a copyright gone, one spelling of each word
    with several."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, r"(?m)^[\t ]*(copyright|\(c\)|©)[^\n]*$", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for other, chosen in EQUAL:
        text = F.replace(text, F.lit(other), F.lit(chosen))
    return F.array_remove(F.split(F.trim(F.regexp_replace(text, " ?\n ?", "\n")), "\n"), "")


def known_digests(spark: SparkSession) -> DataFrame:
    """The digests of all known licences: as many rows as KNOWN has, at most."""
    table = spark.createDataFrame(KNOWN, "licence string, text string")
    return table.select("licence", F.md5(F.array_join(
        canonical_lines(F.col("text")), " ")).alias("digest")).groupBy("digest").agg(
            F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences that a document is, or whose notices are lines of it; other columns stay.

    `whole_licence`: the licence whose digest the entire canonical text has, else null;
    `n_notices`: lines whose entire canonical form has a known digest, each time it occurs;
    `notices`: their licences, each once, sorted, parted by commas (empty without any).
    `known` has columns digest and licence (one row per digest) and is broadcast if it is the
    built-in list, whose size is fixed; any other is joined as its size suggests.

    Null and empty texts, and texts of punctuation only, match nothing. Every row gets a result,
    also with a null or repeated doc_id. An empty table gives an empty one.
    """
    fixed = known is None
    known = known_digests(docs.sparkSession) if fixed else known
    known = F.broadcast(known) if fixed else known
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"),
                        canonical_lines(F.col("text")).alias("lines"))
    units = lines.select("doc", "row", F.explode(F.concat(
        F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"),
                                                F.md5(x).alias("digest"))),
        F.array(F.struct(F.lit(True).alias("whole"), F.when(F.size("lines") > 0, F.md5(
            F.array_join("lines", " "))).alias("digest"))))).alias("u")).select("doc", "row", "u.*")
    # Rows alike in doc_id and text find the same: their counts are shared out again.
    hits = (
        units.join(known, "digest").groupBy("doc", "row").agg(
            F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"),
            F.count_if(~F.col("whole")).alias("n"), F.count_if(F.col("whole")).alias("wholes"),
            F.collect_set(F.when(~F.col("whole"), F.col("licence"))).alias("names")))
    copies = docs.groupBy(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row")).agg(
        F.count("*").alias("copies"))
    hits = hits.join(copies, hits["doc"].eqNullSafe(copies["doc"]) & (hits["row"] == copies["row"])
                     ).select(hits["doc"], hits["row"], "whole_licence", "names",
                              (F.col("n") / F.col("copies")).cast("long").alias("n"))
    mine, names = sheltered(docs, MADE)
    found = hits.select(F.col("doc").alias("_doc"), F.col("row").alias("_hit"), "whole_licence",
                        "names", "n")
    return mine.withColumn("row", F.xxhash64("text")).join(
        found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_hit")),
        "left").select(
            *names, "whole_licence", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
            F.coalesce(F.array_join(F.array_sort("names"), ","), F.lit("")).alias("notices"))


def sql() -> str:
    def canonical(column: str) -> str:
        text = (f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), "
                r"'(?m)^[\t ]*(copyright|\(c\)|©)[^\n]*$', '', 'g'), "
                r"'[^\p{L}\p{N}\n]+', ' ', 'g')")
        for other, chosen in EQUAL:
            text = f"replace({text}, '{other}', '{chosen}')"
        return (f"list_filter(string_split(trim(regexp_replace({text}, ' ?\\n ?', chr(10), 'g'), "
                "' '), chr(10)), lambda x: x <> '')")

    rows = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in KNOWN)
    return f"""
WITH k AS (
  SELECT md5(array_to_string({canonical('text')}, ' ')) AS digest, min(licence) AS licence
  FROM (VALUES {rows}) AS t(licence, text) GROUP BY 1),
d AS (SELECT doc_id, {canonical('text')} AS lines FROM documents),
n AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
  FROM (SELECT doc_id, md5(unnest(lines)) AS digest FROM d) JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, k.licence AS whole_licence, coalesce(n, 0) AS n_notices,
       coalesce(names, '') AS notices
FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN k ON len(lines) > 0 AND k.digest = md5(array_to_string(lines, ' '))
"""
