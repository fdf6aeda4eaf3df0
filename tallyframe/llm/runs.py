"""Periodic stretches of words ("runs") found from Lyndon arrays and collapsed to their first period.

Method: the first phase of a grouping suffix sorter refines groups of suffixes from the highest to the lowest and
so leaves, for every position, its longest Lyndon prefix; it is run under both orders of the words. A Lyndon
root followed by its copy is extended to both sides as far as words one period apart agree, which gives
the run. Phase one only sees stretches in which every word lies in a repeated group of words of its document:
a run of at least ``MIN_WORDS`` words and three periods cannot leave such a stretch.

Every row is worked on where it is read: no shuffle, no state between rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.columns import kept_fields
from tallyframe.llm.words import mix

#: A run has at least so many words and three periods.
MIN_WORDS = 24
#: Words of a group that a run must repeat: of 24 words in three periods every word lies in such a group.
GROUP = 8
#: Bytes of a text split into words at once, and words hashed or joined at once.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 16
#: Bytes of texts whose words are numbered and searched together.
STEP_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


@dataclass(frozen=True, order=True)
class Run:
    start: int
    length: int
    period: int


def word_numbers(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers, equal words alike; ``known`` gains the new ones. Long texts go piece by piece."""
    parts, at = [], 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE_BYTES)  # a piece ends between words
        end = space.start() if space else len(raw)
        parts.append(np.array([known.setdefault(w, len(known)) for w in raw[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def groups_repeated(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True for words inside a group of ``GROUP`` words that its document holds twice; ``firsts`` ends with the count.

    Groups are told apart by hash: words of unlike groups may be marked too, none is missed.
    """
    marked = np.zeros(len(words) + 1, np.int32)
    if len(words) < GROUP:
        return marked[:-1].astype(bool)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    h = mix(words.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):  # of two, four and eight words
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
    inside = doc[: len(h)] == doc[GROUP - 1 :]
    at = np.flatnonzero(inside)
    h = mix(h[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    twice = at[np.union1d(order[same], order[same + 1])]
    np.add.at(marked, twice, 1)
    np.add.at(marked, twice + GROUP, -1)
    return np.cumsum(marked)[:-1] > 0


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position, by grouping suffixes.

    Groups start as equal first words and are taken from the highest to the lowest. Taking a group removes its
    members from the list of open positions; the open position before a row of l members gains l copies of the
    group's word at its own word's end, so it moves to a new group just above its old one, further above the larger
    l is. At its removal, the next open position is where a position's longest Lyndon word ends.
    """
    n = len(ranks)
    _, first = np.unique(ranks, return_inverse=True)
    group = first.tolist()
    count = max(group, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, count - 1)), [*range(1, count), -1]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    top = count - 1
    while top >= 0:
        gained: dict[int, list[int]] = {}
        now = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in now:
            p = before[i]
            if p >= 0 and group[p] == top:
                continue  # not the first of its row
            length, end = 1, after[i]
            while end < n and group[end] == top:
                length, end = length + 1, after[end]
            before[end] = p
            if p >= 0:
                after[p] = end
                gained.setdefault(length, []).append(p)
        made: dict[int, int] = {}
        for length in sorted(gained, reverse=True):
            made.clear()
            for p in gained[length]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    up = above[old]
                    above[old] = new
                    below.append(old)
                    above.append(up)
                    if up >= 0:
                        below[up] = new
                group[p] = new
                members[new].append(p)
        for i in now:
            group[i] = -1
        top = below[top]
    return np.array(after[:n], np.int64) - np.arange(n)


def agree_right(words: np.ndarray, i: int, j: int) -> int:
    """How many words from ``i`` and from ``j`` (the later) on are equal; compared in growing pieces."""
    got, size = 0, 64
    while j + got < len(words):
        a, b = words[i + got : i + got + size], words[j + got : j + got + size]
        unlike = np.flatnonzero(a[: len(b)] != b)
        if len(unlike):
            return got + int(unlike[0])
        got, size = got + len(b), min(2 * size, PIECE_WORDS)
    return got


def agree_left(words: np.ndarray, i: int, j: int) -> int:
    """How many words before ``i`` (the earlier) and before ``j`` are equal."""
    got, size = 0, 64
    while i - got > 0:
        take = min(size, i - got)
        a, b = words[i - got - take : i - got], words[j - got - take : j - got]
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return got + take - 1 - int(unlike[-1])
        got, size = got + take, min(2 * size, PIECE_WORDS)
    return got


def squares(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions whose Lyndon word may be followed by its copy: its first four words are found again one word length on."""
    n, at = len(words), np.arange(len(words))
    at = at[(at + 2 * lengths <= n) & (3 * lengths <= n)]
    probe = np.ones(len(at), bool)
    for k in range(4):
        d = at + np.minimum(k, lengths[at] - 1)
        probe &= words[d] == words[d + lengths[at]]
    return at[probe]


def stretch_runs(words: np.ndarray) -> set[Run]:
    """All runs of a stretch of words with at least ``MIN_WORDS`` words and three periods."""
    found: set[Run] = set()
    _, ranks = np.unique(words, return_inverse=True)
    for order in (ranks, ranks.max() - ranks):
        lengths = lyndon_lengths(order)
        at = squares(words, lengths)
        period = lengths[at]
        last, reach = -1, -1
        for k in np.lexsort((at, period)).tolist():
            i, q = int(at[k]), int(period[k])
            if q == last and i + 2 * q <= reach:
                continue  # inside the run of this period that was extended last
            right = agree_right(words, i, i + q)
            if right < q:
                continue
            left = agree_left(words, i, i + q)
            start, length = i - left, left + q + right
            last, reach = q, i + q + right
            if length >= max(MIN_WORDS, 3 * q):
                found.add(Run(start, length, q))
    return found


def text_runs(words: np.ndarray, marked: np.ndarray) -> list[Run]:
    """The runs of a text, by start and period; ``marked`` are the words that may lie in one."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    out: list[Run] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= MIN_WORDS:
            out += [Run(r.start + a, r.length, r.period) for r in stretch_runs(words[a:b])]
    return sorted(out, key=lambda r: (r.start, r.period))


def greatest(runs: Sequence[Run]) -> Run | None:
    """The run with the greatest exact length / period; ties: least start, then least period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r  # runs come by start and period, so a tie keeps the earlier
    return best


def collapsed(words: np.ndarray, runs: Sequence[Run]) -> np.ndarray:
    """The words no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r.start + r.period : r.start + r.length] = False
    return words[keep]


def joined_sha256(words: np.ndarray, texts: Sequence[bytes]) -> str:
    """Digest of the words joined by one space, piece by piece."""
    digest = hashlib.sha256()
    for at in range(0, len(words), PIECE_WORDS):
        digest.update((b" " if at else b"") + b" ".join([texts[w] for w in words[at : at + PIECE_WORDS].tolist()]))
    return digest.hexdigest()


def looped(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The registered query's own rule: one id in ten (by checksum) repeats a stretch of its text to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


_RUN = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), loop_ids: str | None = None, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns, n_runs, the greatest run and digests of all runs and of the collapsed text, per row.

    A word is a run of characters other than blank and the controls 9 to 13. ``with_runs`` adds ``runs`` (every run's
    start, length and period), ``with_text`` the collapsed text. ``loop_ids`` names an id column by which the words are
    first changed as in ``looped`` (a null id: unchanged); None leaves them. A null or wordless text has no
    runs: four nulls, digests of nothing. Equal rows get equal results each, ids are not looked at otherwise, an
    empty table gives an empty one, and other columns are not read. A very long text is split into words piece
    by piece and held as four-byte numbers.
    """
    fields = [f.name for f in T._parse_datatype_string(_RUN).fields]
    kept = kept_fields(df, keep)
    schema = T.StructType([*[T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(kept)], *T._parse_datatype_string(_RUN).fields])
    if with_runs:
        schema.add("runs", T._parse_datatype_string("array<struct<start: long, length: long, period: long>>"))
    if with_text:
        schema.add("collapsed_text", "string")
    arrow = to_arrow_schema(schema)
    source = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], (F.col(loop_ids).cast("long") if loop_ids else F.lit(None).cast("long")).alias("__id"), F.col(text).cast("string").cast("binary").alias("__text"))

    def described(words: np.ndarray, marked: np.ndarray, texts: list[bytes]) -> dict:
        runs = text_runs(words, marked) if marked.any() else []
        best, left = greatest(runs), collapsed(words, runs)
        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        row = {"n_runs": len(runs), "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": joined_sha256(left, texts)}
        if best:
            row |= {"start": best.start, "length": best.length, "period": best.period, "exponent_milli": 1000 * best.length // best.period}
        if with_runs:
            row["runs"] = [vars(r) for r in runs]
        if with_text:
            row["collapsed_text"] = b" ".join([texts[w] for w in left.tolist()]).decode()
        return row

    def step(ids: list, texts: list[bytes | None]) -> list[dict]:
        known: dict[bytes, int] = {}
        each = [looped(word_numbers(t, known), i) if loop_ids else word_numbers(t, known) for i, t in zip(ids, [t or b"" for t in texts])]
        firsts = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
        marked = groups_repeated(np.concatenate(each), firsts)
        names = list(known)
        return [described(w, marked[a:b], names) for w, a, b in zip(each, firsts[:-1].tolist(), firsts[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("__id"), batch.column("__text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
                made = step(ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at).to_pylist())
                columns = [*[batch.column(i).slice(at, end - at) for i in range(len(kept))], *[pa.array([r.get(f) for r in made], arrow.field(f).type) for f in arrow.names[len(kept) :]]]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], names=arrow.names)
                at = end

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"__k{i}").alias(f.name) for i, f in enumerate(kept)], *fields, *(["runs"] if with_runs else []), *(["collapsed_text"] if with_text else []))
