"""Repeated word passages found by backward search in a compressed FM-index per shard.

Method: a shard's texts, as words, are sorted by suffix; the Burrows-Wheeler transform is kept as a
wavelet tree of packed bits with rank counts. The texts are streamed against the index from right to left: a step
extends the match by one word with two rank queries, and a match longer than the threshold is cut back to it by the
interval of its parent. These are matching statistics capped at the threshold; where they reach it, the
interval names all occurrences of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tallyframe.llm.repeats import NO_ID, Slot, Spec, Units, without_repeats

#: Words of a passage that counts as repeated.
WINDOW = 20
SPEC = Spec(k=WINDOW, m=6, words=True, within=True)


class WaveletTree:
    """Sequence of small integers as one packed bit array per level, with ones counted up to each 64-bit word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.ones, self.zeros = len(symbols), levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones_before(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = self.bits[level][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start, end = np.zeros_like(i), i
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = self._ones_before(level, start), self._ones_before(level, end)
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - start


class FmIndex:
    """Index of a word sequence (0 separates texts), ordered to ``depth`` words."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n, top = len(symbols), int(symbols.max()) + 1
        rank, have = symbols.astype(np.int64), 1
        while have < depth:  # double the compared length, the last time only as far as needed
            step = min(have, depth - have)
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1
            _, rank = np.unique(rank * (n + top + 1) + later, return_inverse=True)
            have += step
        self.order = np.argsort(rank, kind="stable")
        before = np.where(self.order > 0, symbols[self.order - 1], 0)
        self.tree = WaveletTree(before, max(1, top.bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        ordered = rank[self.order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        bounds = np.append(np.flatnonzero(new), n)
        self.lot = np.cumsum(new) - 1  # the interval at full depth that a row lies in
        self.lots = bounds

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the match with one more word on its left."""
        return self.below[symbol] + self.tree.rank(symbol, lo), self.below[symbol] + self.tree.rank(symbol, hi)

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the first ``depth`` words of a longer match."""
        lot = self.lot[lo]
        return self.lots[lot], self.lots[lot + 1]


def matching_statistics(index: FmIndex, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, lo, hi) at every position of the texts: the longest match up to ``depth`` words that starts there.

    The texts are streamed from their ends, all at once. A match that cannot be extended starts anew at its word.
    """
    length = np.zeros(len(symbols), np.int64)
    los, his = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    lo, hi, have = np.zeros(len(size), np.int64), np.full(len(size), index.tree.n), np.zeros(len(size), np.int64)
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, "left"))  # texts longer than ``step``
        at = begin[:live] + size[:live] - 1 - step
        a, b = index.extend(symbols[at], lo[:live], hi[:live])
        lost = a >= b
        have[:live] = np.where(lost, 1, have[:live] + 1)
        a = np.where(lost, index.below[symbols[at]], a)
        b = np.where(lost, index.below[symbols[at] + 1], b)
        over = have[:live] >= depth
        up_lo, up_hi = index.parent(np.minimum(a, index.tree.n - 1))
        lo[:live], hi[:live] = np.where(over, up_lo, a), np.where(over, up_hi, b)
        have[:live] = np.minimum(have[:live], depth)
        length[at], los[at], his[at] = have[:live], lo[:live], hi[:live]
    return length, los, his


def earlier_windows(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, places: np.ndarray, spec: Spec) -> np.ndarray:
    """For every window of every text: does its word sequence start earlier (id, then place) in any text?"""
    u = Units.of(data, offsets, True)
    names, symbols = np.unique(u.values, return_inverse=True)
    size = np.diff(u.firsts)
    text = np.repeat(np.arange(len(size)), size)
    # A separator after each text; the word at unit i stands at i + its text's number.
    at = np.arange(len(symbols)) + text
    laid = np.zeros(len(symbols) + len(size), np.int64)
    laid[at] = symbols + 1
    begin = u.firsts[:-1] + np.arange(len(size))
    index = FmIndex(laid, spec.k)
    length, lo, _ = matching_statistics(index, laid, begin, size, spec.k)
    # Rank of every place: by id, then by word; equal places of equal ids share it.
    place = np.zeros(len(laid), np.int64)
    place[at] = places[text] + np.arange(len(symbols)) - u.firsts[text]
    owner = np.full(len(laid), NO_ID)
    owner[at] = ids[text]
    sort = np.lexsort((place, owner))
    new = np.concatenate([[False], (owner[sort][1:] != owner[sort][:-1]) | (place[sort][1:] != place[sort][:-1])])
    rank = np.zeros(len(laid), np.int64)
    rank[sort] = np.cumsum(new)
    least = np.minimum.reduceat(rank[index.order], index.lots[:-1])
    starts = at[np.arange(len(symbols)) + spec.k <= u.firsts[text + 1]]
    if (length[starts] < spec.k).any():
        raise AssertionError("a text must find itself in its own index")
    return least[index.lot[lo[starts]]] < rank[starts]


def kept_words(raw: bytes, gone: np.ndarray) -> bytes:
    return b" ".join(compress(raw.split(), ~gone)) if gone.any() else b" ".join(raw.split())


def cut_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without its removed words and the space before each; untouched texts stay as they are."""
    stay = np.ones(len(data), bool)
    begin = np.concatenate([[0], ends[:-1]])
    begin[0] = starts[0]
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin[gone], 1)
    np.add.at(edge, ends[gone], -1)
    stay &= np.cumsum(edge[:-1]) == 0
    return data[stay].tobytes()


def remove_repeated_passages(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), with_text: bool = False, spec: Spec = SPEC
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of kept words joined by blanks), ``keep``, and the cut text if asked for.

    A word goes if a window of ``spec.k`` words that covers it also starts earlier: in a document with a smaller
    id, or before it in the same one. Windows are judged on the input. Null and empty texts have no
    words. Rows without id come last and count as one document; rows of equal id too, so of repeated
    rows each keeps what the other keeps. Other columns are not read; an empty table gives an empty
    result. Very long texts are one step of one task.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField(c, df.schema[c].dataType) for c in keep] + ([T.StructField("cut_text", T.StringType())] if with_text else [])
    schema = T.StructType(fields)
    names = schema.names

    def render(s: Slot, steps: Iterator) -> pa.RecordBatch:
        n, removed, digest, texts = [], [], [], []
        for first, end, data, offsets, u, gone in steps:
            raw = data.tobytes()
            for i in range(end - first):
                x, y = u.firsts[i], u.firsts[i + 1]
                own = raw[offsets[i] : offsets[i + 1]]
                n.append(int(y - x))
                removed.append(int(gone[x:y].sum()))
                digest.append(hashlib.sha256(kept_words(own, gone[x:y])).hexdigest())
                if with_text:
                    cut = removed[-1] > 0
                    texts.append(cut_text(data[offsets[i] : offsets[i + 1]], u.starts[x:y] - offsets[i], u.ends[x:y] - offsets[i], gone[x:y]).decode() if cut else own.decode())
        cols = [s.rows.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        cols += [s.rows.column(f"kept_{i}").combine_chunks() for i in range(len(keep))]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.string())] if with_text else []), names)

    return without_repeats(df, spec, earlier_windows, render, schema, text, doc_id, keep)
