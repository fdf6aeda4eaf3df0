"""Repeated byte strings found by suffix sorting with bucket-pointer refinement.

Method: suffixes are first put into buckets by their leading q bytes. A bucket is refined by sorting its suffixes on the
pointers of the buckets that hold the suffixes q bytes later; the refined pointers are used in turn to refine by
twice the length, and so on up to the length asked for. Suffixes alone in their bucket are settled and
no longer sorted. All comparisons are of bytes or of exact pointers; no hash decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tallyframe.llm.repeats import NO_ID, Slot, Spec, without_repeats

#: Bytes of a string that counts as repeated, and of the initial buckets.
LENGTH, Q = 50, 8
SPEC = Spec(k=LENGTH, m=20, words=False, within=False)


def bucket_pointers(keys: np.ndarray, at: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes ``at`` by ``keys``, point each to the last place of its bucket, and tell which are not alone."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    last = np.append(ordered[1:] != ordered[:-1], True)
    ends = np.flatnonzero(last)
    bucket = np.concatenate([[0], np.cumsum(last)[:-1]])
    pointer[at[order]] = ends[bucket]
    shared = np.zeros(len(at), bool)
    shared[order] = np.diff(np.concatenate([[-1], ends]))[bucket] > 1
    return pointer, shared


def refined(data: np.ndarray, end: np.ndarray, k: int, q: int = Q) -> np.ndarray:
    """Bucket pointer of every suffix by its first ``k`` bytes; -1 where its text ends before, or where no other equals it.

    ``end`` is where the text of each byte ends. A settled suffix gets a pointer of its own, so it still tells
    longer strings apart.
    """
    n = len(data)
    if n < k:
        return np.full(n, -1)
    q = min(q, k)
    lead = np.zeros(n, np.uint64)
    for i in range(q):
        lead[: n - i] |= data[i:].astype(np.uint64) << np.uint64(8 * (q - 1 - i))
    have = q
    at = np.flatnonzero(np.arange(n) + have <= end)
    pointer, shared = bucket_pointers(lead[at], at, np.full(n, -1))
    live = at[shared]
    while have < k:
        step = min(have, k - have)
        # Alone now is alone at every greater length: only shared suffixes are sorted again.
        fits = live + have + step <= end[live]
        live = live[fits]
        keys = pointer[live] * (2 * n + 1) + pointer[live + step]
        fresh, shared = bucket_pointers(keys, live, np.full(n, -1))
        alone = np.ones(n, bool)
        alone[live] = False
        fresh[alone] = n + np.flatnonzero(alone)  # settled: pointers of their own beyond those of the sorted
        pointer, live, have = fresh, live[shared], have + step
    out = np.full(n, -1)
    out[live] = pointer[live]
    return out


def earlier_strings(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, places: np.ndarray, spec: Spec) -> np.ndarray:
    """For every string of ``spec.k`` bytes of every text: does it also start in a text of a smaller id?"""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    end = offsets[1:][text]
    starts = np.flatnonzero(np.arange(len(data)) + spec.k <= end)
    lot = refined(data, end, spec.k)[starts]
    shared = lot >= 0
    least = np.full(len(data), NO_ID)
    np.minimum.at(least, lot[shared], ids[text[starts[shared]]])
    out = np.zeros(len(starts), bool)
    out[shared] = least[lot[shared]] < ids[text[starts[shared]]]
    return out


def remove_repeated_strings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row.

    A byte goes if a string of ``spec.k`` bytes that covers it also starts in a document with a smaller id.
    Strings are judged on the input and never cross documents; cuts may fall inside a character, so what is
    kept are bytes. Null and empty texts have no bytes. Rows without id come last and count as one document, as do rows of
    equal id, so repeated rows do not remove each other. Other columns are not read; an empty table gives an
    empty result. Very long texts are one step of one task.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    names = schema.names

    def render(s: Slot, steps: Iterator) -> pa.RecordBatch:
        n, removed, runs, digest = [], [], [], []
        for first, end, data, offsets, _, gone in steps:
            for i in range(end - first):
                own, cut = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                n.append(len(own))
                removed.append(int(cut.sum()))
                runs.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if removed[-1] else 0)
                digest.append(hashlib.sha256((own[~cut] if removed[-1] else own).tobytes()).hexdigest())
        cols = [s.rows.column("doc_id").combine_chunks(), *[pa.array(c, pa.int64()) for c in (n, removed, runs)], pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names)

    return without_repeats(df, spec, earlier_strings, render, schema, text, doc_id)
