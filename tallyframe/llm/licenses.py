"""Whole texts looked up by digest among known licences.

Method: case, punctuation, copyright lines and equivalent spellings are normalised on both sides, and the
digest of the entire normalised text is hash-joined to the digests of the known texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyframe.llm.columns import kept_fields, with_text
from tallyframe.plans.durable import durable

# Spellings that licence matching guidelines treat as the same.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "colour": "color",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Texts published by the licences' stewards, and the notices that stand for a whole licence.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
]
KNOWN_SCHEMA = "license_id string, text string"
#: Folder of further known texts and notices; add files there or name other folders.
STORED = Path(__file__).parent / "known_licenses"

#: A notice line: comment marks, then the word or sign, then a sign, a year or nothing more than a holder's mark.
NOTICE = re.compile(r"[\s#*/;%-]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|:|[0-9]{4}).*|all rights reserved\.?\s*)")
_MARKS = ("copyright", "(c)", "©", "all rights")
_WORD = re.compile(r"[^\W_]+")


def line_words(line: str) -> list[str]:
    """Words of letters and digits of a lower-case line in one spelling; none of a notice line."""
    if any(m in line for m in _MARKS) and NOTICE.fullmatch(line):
        return []
    words = _WORD.findall(line)
    return words if SPELLINGS.keys().isdisjoint(words) else [SPELLINGS.get(w, w) for w in words]


def _digest(words: list[str]) -> bytes | None:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest() if words else None


def digests(text: str | None) -> tuple[bytes | None, list[bytes]]:
    """Digest of the entire normalised text, and of each line that has words; null without words."""
    lines = [w for line in (text or "").lower().split("\n") if (w := line_words(line))]
    whole = _digest(list(chain.from_iterable(lines)))
    return whole, [whole] if len(lines) == 1 else [_digest(w) for w in lines]


def hashed(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, whole binary and lines array<binary> of every row; no shuffle."""
    keep = list(keep)
    schema = T.StructType(
        [*kept_fields(df, keep), T.StructField("__whole", T.BinaryType()), T.StructField("__lines", T.ArrayType(T.BinaryType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                both = [digests(t.as_py()) for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([w for w, _ in both], pa.binary()), pa.array([x for _, x in both], pa.list_(pa.binary()))],
                    [*keep, "__whole", "__lines"],
                )

    return with_text(df, text, keep).mapInArrow(run, schema)


def stored_licenses(folder: str | Path = STORED) -> list[tuple[str, str]]:
    """(license_id, text) of a folder: each ``<id>.txt`` is an entire text, each line of ``notices.tsv`` an id, a tab and a notice."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt"))]
    notices = Path(folder) / "notices.tsv"
    lines = notices.read_text(encoding="utf-8").splitlines() if notices.exists() else []
    return texts + [tuple(x.split("\t", 1)) for x in lines if "\t" in x]


def builtin_licenses(spark: SparkSession, *folders: str | Path) -> DataFrame:
    """The known licences, with those of the stored folder and of the user's own ``folders``."""
    return spark.createDataFrame([x for f in (STORED, *folders) for x in stored_licenses(f)] + KNOWN, KNOWN_SCHEMA)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license): one row per digest of a table (license_id, text); the least id stands for equal texts."""
    rows = hashed(known, "text", ["license_id"]).filter("__whole is not null")
    return rows.groupBy(F.col("__whole").alias("__digest")).agg(F.min("license_id").alias("__license"))


def scan(df: DataFrame, known: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, text_digest, license_id, n_license_lines and line_licenses of every row.

    license_id names the known licence that the entire text is, line_licenses those that one of its lines is as an entire text
    (a notice), comma-joined. ``known`` (license_id, text) is written first, so it is broadcast while it is small
    and shuffled otherwise. Only matched lines and one row per text go on to be grouped. Repeated rows
    come back each; a null or wordless text has a null digest; other columns are not read; an empty known
    table matches nothing and an empty table gives an empty result.
    """
    look = durable(known_digests(known), "licenses")
    keep = list(keep)
    rows = hashed(df, text, keep).withColumn("__row", F.monotonically_increasing_id())
    whole = F.struct(F.lit(True).alias("whole"), F.col("__whole").alias("digest"))
    lines = F.transform("__lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("digest")))
    parts = rows.select(*keep, "__row", F.explode(F.concat(F.array(whole), lines)).alias("__p")).select(*keep, "__row", "__p.whole", F.col("__p.digest").alias("__digest"))
    found = parts.withColumnRenamed("whole", "__is_whole").join(look, "__digest", "left").filter(F.col("__is_whole") | F.col("__license").isNotNull())
    grouped = found.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in keep],
        F.max(F.when(F.col("__is_whole"), F.lower(F.hex("__digest")))).alias("text_digest"),
        F.max(F.when(F.col("__is_whole"), F.col("__license"))).alias("license_id"),
        F.sum((~F.col("__is_whole")).cast("long")).alias("n_license_lines"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~F.col("__is_whole"), F.col("__license"))))).alias("line_licenses"),
    )
    return grouped.drop("__row")
