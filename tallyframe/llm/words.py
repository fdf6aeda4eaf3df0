"""Words, word hashes and window hashes of many documents at once, as flat arrays inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the rolling hashes; being odd they have inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(b: int) -> np.ndarray:
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return table(base), table(pow(base, -1, 1 << 64))


#: Tables up to this length stay for the next step, one pair per base; longer ones go with the text that needs them.
_STAY = 1 << 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least ``n``."""
    have = _TABLES.get(base)
    if have is not None and len(have[0]) >= n:
        return have
    made = _table(base, 1 << max(16, int(n).bit_length()))
    if len(made[0]) <= _STAY:
        _TABLES[base] = made
    return made


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Rolling sums: prefix[j] - prefix[i] is the hash of values[i:j] times base**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of every span [start, end), the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of every document (one more at the end).

    A word is a run of bytes other than blank and the controls 9 to 13; documents are never joined.
    """
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Longer words are hashed one by one.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: its length, then its bytes in blocks of eight, each mixed into what came before.

    Words of one length up to eight bytes never share a hash. Sums of powers would not do here: for any odd base there
    are unlike texts (of 1,024 signs of two kinds, say) with equal sums modulo 2**64.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    live, at = np.flatnonzero(size <= _LONG_WORD), 0
    while len(live):
        left = size[live] - at
        cut = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
        block = eight[starts[live] + at] << cut >> cut
        h[live] = mix((h[live] ^ block) * np.uint64(BYTE_BASE))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, "<u8")[0]
    return h


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every window of ``k`` words that lies in one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(n, bool)
    for back in range(1, k):  # a window that starts fewer than k words before a document's end leaves it
        cut = firsts[1:] - back
        ok[cut[(cut >= 0) & (cut < n) & (cut >= firsts[:-1])]] = False
    starts = np.flatnonzero(ok)
    sums = prefix(hashes, WORD_BASE)
    return starts, span_hashes(sums, starts, starts + k, WORD_BASE)
