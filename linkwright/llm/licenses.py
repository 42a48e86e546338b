"""License scan by canonical digests, with DataFrame functions only.

A text's canonical form drops copyright lines, case, punctuation and line ends, and settles equivalent spellings; its MD5 is joined
with the digests of known license texts, of which there may be any number.  The same is done for each line, since a license is
often stated by a sentence of its own.  Canonical forms don't depend on where lines are wrapped.

A null or empty text, or one of copyright lines alone, has an empty canonical form, which is no license.  Texts are taken whole.
Rows that repeat are judged alike, and columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, let, saved

# Spellings taken for another, first in words as they stand, then between single blanks.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("&", " and "), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"))
PHRASES = ((" non commercial ", " noncommercial "), (" sub license ", " sublicense "), (" per cent ", " percent "))

# How a copyright line begins, after lower-casing, and how a sentence does that has been wrapped before the word.
STATES = r"^[^\pL\pN]*(copyright|\(c\)|©|all rights reserved)"
GOES_ON = r"^[^\pL\pN]*copyright[^\pL\pN©(<]*($|(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|in|to|of|the|is|are|on)([^\pL\pN]|$))"

# Texts of licenses.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: (license, text).  A license may have several texts.
KNOWN = (
    ("MIT", MIT), ("MIT", MIT.partition("\n\n")[2]), ("ISC", ISC), ("ISC", ISC.partition("\n\n")[2]), ("0BSD", ZERO_BSD), ("0BSD", ZERO_BSD.partition("\n\n")[2]),
    ("BSD-2-Clause", f"{BSD_CLAUSES}\n\n{BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_CLAUSES}\n\n{BSD_END}"),
    ("BSD-3-Clause", f"{BSD_CLAUSES}\n\n{BSD_THIRD}\n\n{BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_CLAUSES}\n\n{BSD_THIRD}\n\n{BSD_END}"),
    ("Zlib", ZLIB), ("Zlib", ZLIB.partition("\n\n")[2]),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)


def copyright_line(line: Column) -> Column:
    """Whether a line states a copyright: it begins with the word, a sign or the reservation, and no sentence goes on from there."""
    low = F.lower(line)
    return low.rlike(STATES) & ~low.rlike(GOES_ON)


def folded(text: Column) -> Column:
    """Lower-case words between single blanks, equivalent spellings settled, wherever lines are wrapped."""
    x = F.lower(text)
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    y = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in PHRASES:
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.trim(y)


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; empty if only copyright lines, or no letters and digits, are left."""
    return folded(F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~copyright_line(x)), " "))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs with digest (of the whole text; null if nothing is left), license (of the whole text) and line_licenses (sorted)."""
    docs = docs.drop("digest", "license", "line_licenses")
    table = saved(digests(known if known is not None else known_texts(docs.sparkSession)), "license-digests")
    keys = {"_text": F.xxhash64("text"), "_text2": F.xxhash64("text", F.lit(1))}
    # the licenses of lines depend on the text alone
    lines = docs.select(*(c.alias(k) for k, c in keys.items()), F.explode(F.split("text", "\n")).alias("line")).where(~copyright_line(F.col("line")))
    found = lines.select("_text", "_text2", F.md5(folded(F.col("line"))).alias("_digest")).join(hinted(table, 120), "_digest")
    found = saved(found.groupBy("_text", "_text2").agg(F.sort_array(F.collect_set("_license")).alias("_lines")), "line-licenses")
    whole = let(canonical(F.col("text")), lambda w: F.when(w != "", F.md5(w)))
    out = docs.withColumns(keys | {"_found": whole}).join(hinted(found, 160), ["_text", "_text2"], "left").join(hinted(table, 120), F.col("_found") == F.col("_digest"), "left")
    return out.select(*docs.columns, F.col("_found").alias("digest"), F.col("_license").alias("license"), F.coalesce("_lines", F.array().cast("array<string>")).alias("line_licenses"))


def known_texts(spark: SparkSession) -> DataFrame:
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN) + " AS t(license, text)")


def digests(known: DataFrame) -> DataFrame:
    """(_digest, _license) of known texts; of equal texts, the license that sorts first."""
    forms = known.select(canonical(F.col("text")).alias("form"), "license").where("form <> ''")
    return forms.select(F.md5("form").alias("_digest"), F.col("license").alias("_license")).groupBy("_digest").agg(F.min("_license").alias("_license"))
