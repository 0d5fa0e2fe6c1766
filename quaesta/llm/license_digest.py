"""Licence scan by canonical digests (operator 8), in DataFrame functions only.

A text is brought to a canonical form (lower case, copyright lines dropped, runs of
anything but letters and digits made one space, equivalent spellings made one) and its
SHA-256 is looked up among the digests of known licences, for the entire text by a
hash join; entire lines, as short notices stand in files, are looked up the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings; fixed values, applied in this order to canonical text.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Known licence texts and notices; fixed values (public licence texts).
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Known texts at most: their digests are literals of the plan and a broadcast table.
MAX_KNOWN = 1000
#: Lines shaped like notices: a sign or the word, then a year, a sign or "by"; running text that wraps at the word is none.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*((copyright[^\p{L}\p{N}\n(©]*)?(\(c\)|©)|copyright[^\p{L}\p{N}\n]*([0-9]{4}|by |yyyy|year)|all rights reserved)[^\n]*$"
#: Titles that licence texts start with; fixed values.
TITLE = r"^(the )?(mit license( mit)?|mit|isc license( isc)?|(new |simplified |modified )?bsd license|bsd [23] clause( new or revised| simplified)? license|zero clause bsd|bsd zero clause license) "


def canonical_lines(text: Column) -> Column:
    """Lower case without notices; runs of anything but letters, digits and line ends are one space."""
    c = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    c = F.regexp_replace(c, "(?d)" + COPYRIGHT_LINE, "")
    return F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")


def spelled(c: Column) -> Column:
    for other, one in SPELLINGS:
        c = F.replace(c, F.lit(other), F.lit(one))
    return c


def canonical(lines: Column) -> Column:
    """The entire text on one line, where words cut by a line's end meet, in one spelling and without its title."""
    return F.regexp_replace(spelled(F.trim(F.regexp_replace(lines, r"[ \n]+", " "))), TITLE, "")


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``(license_id, license_digest)``; of known texts with one digest, the first id by name."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("t")) for i, t in known)))
    df = spark.range(1).select(rows.alias("r")).select("r.license_id", F.sha2(canonical(canonical_lines(F.col("r.t"))), 256).alias("license_digest"))
    return df.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(
    docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per input row ``doc_id, digest, license_id, line_licenses``.

    ``license_id``: the licence that the entire text is, else null; ``line_licenses``: sorted ids of licences that an
    entire line is. A null text has a null digest and no licences; an empty one, or one of copyright lines alone, has
    the digest of the empty text and none either. How a licence text is wrapped, and a title before it, make no difference. Other columns are ignored, repeated rows are each returned, an empty
    table gives no rows.
    """
    if len(known) > MAX_KNOWN:
        raise ValueError(f"known licences are inlined into the plan: at most {MAX_KNOWN}")
    hit = known_licenses(docs.sparkSession, known).where(F.col("license_digest") != F.sha2(F.lit(""), 256))
    of_line = [x for r in hit.collect() for x in (F.lit(r["license_digest"]), F.lit(r["license_id"]))]
    of_line = F.create_map(*of_line) if of_line else F.lit(None).cast("map<string,string>")
    text = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    text = text.select("doc_id", "lines", F.sha2(canonical(F.col("lines")), 256).alias("digest"))
    text = text.join(F.broadcast(hit), text["digest"] == hit["license_digest"], "left")
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: spelled(F.trim(x))), lambda x: x != "")
    ids = F.filter(F.transform(lines, lambda x: F.try_element_at(of_line, F.sha2(x, 256))), lambda x: x.isNotNull())
    return text.select("doc_id", "digest", "license_id", F.coalesce(F.array_sort(F.array_distinct(ids)), F.array().cast("array<string>")).alias("line_licenses"))
