"""Licence scan by canonical digests of entire texts.

A text is brought to canonical form: lower case, copyright lines and ``all rights reserved`` dropped,
equivalent spellings unified (licence and license, sub-licence, merchantability and the like),
punctuation and white space gone. The SHA-256 of what is left is joined with the digests of known
licence texts. Every run of whole lines that is as long in canonical form as a known text is looked up:
the whole document, lines, paragraphs, and texts of many paragraphs inside other text, however wrapped.
A text is brought to canonical form once, and the runs of a length are found by a sorted search among
the line ends of many texts at once; the cost grows with the number of different lengths known.

The known texts are a table (license_id, text); ``NOTICES`` are the standard notices built in, and with
them the full texts in the folder license_texts and those of ``BSD``. The
table of digests is broadcast only below ``KNOWN_ROWS`` rows; otherwise the join shuffles the digests.
A document without any known text, a null or an empty one gets an empty list; an empty table gives an
empty result. Rows are told apart by two hashes of their whole content, so null ids and repeated rows do
no harm; other columns are carried along, those named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takerank.llm.cluster import ready

KNOWN_ROWS = 50_000

# Spellings that count as equal, as the licence matching guidelines of SPDX list them.
SPELLINGS = (
    ("licence", "license"), ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("centre", "center"), ("cheque", "check"), ("favour", "favor"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("sub-license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("(c)", "copyright"), ("©", "copyright"), ("https:", "http:"),
)

FULFIL = r"fulfil\b"  # becomes fulfill
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n].*(?:(?:19|20)\d\d|copyright).*|copyright \d.*|all rights reserved[^\p{L}\p{N}\n]*)$"

# The standard notices of well-known licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Clauses with numbers and with signs only.
BSD = tuple((f"BSD-{n}-Clause", _BSD + "".join((f"{i + 1}. " if numbered else "* ") + c + "\n\n" for i, c in enumerate(_BSD_CLAUSES[:n])) + _BSD_END) for n in (2, 3) for numbered in (True, False))


def full_texts() -> list[tuple[str, str]]:
    """The full texts built in, as (license_id, text)."""
    return [*BSD, *((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))]


def known(spark: SparkSession) -> DataFrame:
    """The notices and full texts built in, as a table (license_id, text)."""
    return spark.createDataFrame([*NOTICES, *full_texts()], "license_id string, text string")


_FULFIL, _COPYRIGHT, _REST = regex.compile(FULFIL), regex.compile(COPYRIGHT_LINE), regex.compile(r"[^\p{L}\p{N}\n]+")


def canonical_lines(text: str) -> list[str]:
    """The lines of a text in canonical form; copyright lines, which begin with the word or sign, are empty."""
    low = text.lower()
    for a, b in SPELLINGS:
        low = low.replace(a, b)
    low = _FULFIL.sub("fulfill", low)
    if "copyright" in low or "all rights reserved" in low:
        low = _COPYRIGHT.sub("", low)
    return _REST.sub("", low).split("\n")


def runs(texts: list[str | None], lengths: list[int]) -> Iterator[tuple[int, bool, bytes]]:
    """(place of a text, whether it is the whole text, SHA-256) of the runs of whole lines of one of the lengths."""
    gap = max(lengths, default=0) + 1
    forms, ends, base, first = [], [], 0, []
    for t in texts:
        lines = [x for x in canonical_lines(t or "") if x]
        forms.append("".join(lines))
        first.append(base)
        ends.append(base + np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)]))
        base = int(ends[-1][-1]) + gap  # no run goes on into the next text
    if not texts:
        return
    every, begins = np.concatenate(ends), np.array(first)
    for n in lengths:
        at = np.minimum(np.searchsorted(every, every + n), len(every) - 1)
        for start in every[every[at] == every + n].tolist():
            i = int(np.searchsorted(begins, start, side="right")) - 1
            start -= first[i]
            yield i, n == len(forms[i]), hashlib.sha256(forms[i][start : start + n].encode("utf-8", "surrogatepass")).digest()


def digests(texts: DataFrame) -> DataFrame:
    """license_id, SHA-256 and length of the canonical form of each known text; empty forms are left out."""
    ready(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = ["".join(canonical_lines(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(f.encode("utf-8", "surrogatepass")).digest() for f in forms], pa.binary()), pa.array([len(f) for f in forms], pa.int64())], names=["license_id", "sha256", "n"])

    return texts.selectExpr("cast(license_id AS string) AS license_id", "cast(text AS string) AS text").mapInArrow(run, "license_id string, sha256 binary, n long").where("n > 0").distinct()


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """docs with the columns licenses (sorted ids found) and whole_text (the id that the entire text is, or null)."""
    names = ["licenses", "whole_text"]
    table = digests(known(docs.sparkSession) if texts is None else texts)
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row")
    keys = [f"row.`{c}`" for c, kind in docs.dtypes if c not in names and "map<" not in kind and "variant" not in kind]
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("rid", F.struct(F.xxhash64("t", *keys).alias("a"), F.xxhash64(F.lit("b"), "t", *keys).alias("b")))
    lengths = [r.n for r in table.select("n").distinct().orderBy("n").collect()]  # far fewer than texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(runs(batch.column(1).to_pylist(), lengths))
            if found:
                place, whole, digest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(whole), pa.array(digest, pa.binary())], names=["rid", "whole", "sha256"])

    unit = rows.select("rid", "t").mapInArrow(run, "rid struct<a: bigint, b: bigint>, whole boolean, sha256 binary")
    small = table.limit(KNOWN_ROWS + 1).count() <= KNOWN_ROWS
    hits = unit.join(F.broadcast(table) if small else table, "sha256")
    found = hits.groupBy("rid").agg(F.sort_array(F.collect_set("license_id")).alias("licenses"), F.min(F.when(F.col("whole"), F.col("license_id"))).alias("whole_text"))
    out = rows.select("rid", "row").join(found, "rid", "left")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in names], F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "whole_text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, licenses joined by commas, and the id that the entire text is."""
    return scan(docs.select("doc_id", "text")).select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.col("whole_text").alias("whole_license"))
