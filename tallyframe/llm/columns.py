"""Small schema and file helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes of text that one step of a task works on; a longer text is worked on alone.
STEP_BYTES = 1 << 20


def with_text(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Only the columns an operator needs, the text renamed so that no kept column clashes with it."""
    return df.select(*keep, F.col(text).cast("string").alias("__text"))


def kept_fields(df: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keep]


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two 64-bit digests of id and text: names a row by what it holds, so repeated rows share it."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(F.col(doc_id), t, F.lit(1)), F.xxhash64(F.lit(2), t, F.col(doc_id))


def text_steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, raw, data = texts.buffers()
    offsets = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, whole[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()  # workers live on into the next stage
