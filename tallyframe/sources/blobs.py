"""Stored objects as tables: listings without contents, and digests of what has to be read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Larger objects do not fit one binary value; they are listed and left unread.
MAX_BYTES = (1 << 31) - 1 - (1 << 20)


def _files(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root)


def _named(root: str) -> list[Column]:
    place = re.sub(r"^\w+:(?://[^/]*)?", "", root.rstrip("/"))
    # Up to the root's own path: everything for an absolute one, up to its first occurrence for a relative one.
    lead = r"^\w+:(?://[^/]*)?" + ("" if place.startswith("/") else ".*?/")
    return [
        F.regexp_replace("path", f"{lead}\\Q{place}\\E/", "").alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    ]


def list_objects(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(name, size_bytes, modified_at)`` of every file under ``root``, names relative to it; no content is read.

    Spark's file scans pass over files of 0 bytes, so those are not listed.
    """
    return _files(spark, root, pattern).select(*_named(root))


def digest_objects(
    spark: SparkSession, root: str, pattern: str | None = None, since: str | None = None, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The listing with ``computed_digest`` (SHA-256), NULL for what was not read: files larger than ``max_bytes`` and, with
    ``since``, files not modified from then on. Both bounds are settled from the listing, before a file is opened."""
    files = _files(spark, root, pattern)
    read = F.col("length") <= max_bytes
    if since is not None:
        read = read & (F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    digest = F.sha2("content", 256).alias("computed_digest")
    rest = files.filter(~read).select(*_named(root), F.lit(None).cast("string").alias("computed_digest"))
    return files.filter(read).select(*_named(root), digest).unionByName(rest)
