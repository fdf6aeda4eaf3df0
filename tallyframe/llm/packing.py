"""Fixed-length sequences filled along a Hilbert curve through hashed document vectors.

Method: each document's hashed token vector is projected to three dimensions and the point's place on a
Hilbert curve becomes its key. Documents are range-sorted by key; their tokens, laid end to end in
that order, are cut every ``length`` tokens, so neighbours on the curve share sequences and only the
end of the whole stream is shorter. That end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tallyframe.llm.bpe import OTHER, byte_symbols
from tallyframe.llm.columns import kept_fields, with_text
from tallyframe.llm.words import mix
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import CHUNK, Running, range_chunks, running

LENGTH = 1024
DIMENSIONS, BITS = 3, 16
#: Steepness of the squashing before a projection is cut into 2**BITS levels.
STEEPNESS = 4.0


class Ids:
    """Token ids as the tokenizer file's own library gives them, without added tokens at the ends.

    Texts in the scripts below U+0530 take a faster encoder over the same ranks; tests hold it to the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level files without normalizer are encoded")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.library = Tokenizer.from_file(path)
        pattern = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


@functools.lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    return Ids(path)


@functools.lru_cache(maxsize=2)
def projection(size: int) -> np.ndarray:
    """Hashed direction of every token: a sum of four uniforms per dimension, near normal."""
    seeds = np.arange(size * DIMENSIONS * 4, dtype=np.uint64).reshape(size, DIMENSIONS, 4)
    return ((mix(seeds + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5).sum(axis=2).astype(np.float32)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) of DIMENSIONS coordinates of BITS bits."""
    x = [points[:, i].astype(np.int64) for i in range(DIMENSIONS)]
    bit = 1 << (BITS - 1)
    while bit > 1:  # undo the rotations and reflections from the coarsest cell down
        low = bit - 1
        for i in range(DIMENSIONS):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, DIMENSIONS):
        x[i] = x[i] ^ x[i - 1]
    turn, bit = np.zeros(len(points), np.int64), 1 << (BITS - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros(len(points), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMENSIONS):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def curve_keys(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    mean = sums / np.maximum(counts, 1)[:, None]
    level = (0.5 + 0.5 * np.tanh(STEEPNESS * mean)) * ((1 << BITS) - 1)
    return hilbert(level.astype(np.int64))


def tokenized(df: DataFrame, tokenizer: str, text: str, keep: Sequence[str], end_id: int) -> DataFrame:
    """``keep``, the packed ids (end id included), their count and the Hilbert key."""
    keep = list(keep)
    schema = T.StructType(
        [
            *kept_fields(df, keep),
            T.StructField("__ids", T.BinaryType()),
            T.StructField("__n", T.LongType()),
            T.StructField("__curve", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        directions, kind = projection(max(ids.size, end_id + 1)), id_type(ids.size)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                packed, n, sums = [], [], np.zeros((part.num_rows, DIMENSIONS))
                for i, t in enumerate(part.column(len(keep)).to_pylist()):
                    own = np.append(ids.encode(t or ""), np.uint32(end_id))
                    sums[i] = directions[own].sum(axis=0, dtype=np.float64)
                    packed.append(own.astype(kind).tobytes())
                    n.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(packed, pa.binary()), pa.array(n, pa.int64()), pa.array(curve_keys(sums, np.array(n)))],
                    [*keep, "__ids", "__n", "__curve"],
                )

    return with_text(df, text, keep).mapInArrow(run, schema)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def tail_cuts(rest: int) -> list[int]:
    """Starts and end of the powers of two that ``rest`` tokens are made of, largest first."""
    cuts = [0]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def pieces_of(start: int, n: int, length: int, body: int, cuts: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(start in document, length, sequence, offset) of a document laid at ``start``; cuts end the stream after ``body``."""
    out, at, end = [], start, start + n
    while at < end:
        if at < body:
            seq, offset = divmod(at, length)
            stop = min(end, (seq + 1) * length)
        else:
            k = int(np.searchsorted(cuts, at - body, "right")) - 1
            seq, offset, stop = body // length + k, at - body - cuts[k], min(end, body + cuts[k + 1])
        out.append((at - start, stop - at, seq, offset))
        at = stop
    return out


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key.

    Texts are encoded once and written with their keys; only (key, id, count) is sorted. Null and empty
    texts are one end token. Ties on the curve follow the id; repeated rows are packed each. Null ids are
    packed like others; other columns are not read; an empty table gives an empty result.
    """
    made = tokenized(df, tokenizer, text, [doc_id], end_id).withColumn("__row", F.monotonically_increasing_id())
    made = durable(made.withColumnRenamed(doc_id, "doc_id"), "ids")
    ranged = range_chunks(made.select("doc_id", "__row", "__curve", "__n"), [], ["__curve", "doc_id", "__row"])
    laid = running(ranged, [], ["__curve", "doc_id", "__row"], F.col(CHUNK), [Running("__start", "sum", F.col("__n"), before=True)])
    total = made.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    body, cuts, size = total - total % length, tail_cuts(total % length), ids_of(tokenizer).size
    placed = made.select("__row", "doc_id", "__ids", "__n", "__curve").join(laid.select("__row", "__start"), "__row").drop("__row")
    schema = T.StructType(
        [made.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(size)
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for i, (raw, n, key, start) in enumerate(zip(rows["__ids"], rows["__n"], rows["__curve"], rows["__start"])):
                wide = memoryview(np.frombuffer(raw, kind).astype("<u4").tobytes())
                out += [
                    (i, s, m, zlib.crc32(wide[4 * s : 4 * (s + m)]), n, seq, offset, key)
                    for s, m, seq, offset in pieces_of(start, n, length, body, cuts)
                ]
            if out:
                row, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), *[pa.array(c, pa.int64()) for c in rest]], schema.names
                )

    return placed.select("doc_id", "__ids", "__n", "__curve", "__start").mapInArrow(cut, schema)
