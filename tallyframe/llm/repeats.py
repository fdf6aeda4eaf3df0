"""Finding windows that occur earlier elsewhere, in shards small enough for an index in memory.

Shared by the substring operators. Text is cut into units (words or bytes) and every window of ``k`` units is
owned by its minimizer, the least-hashed ``m``-gram in it, so equal windows have equal minimizers.

1. Rows are dealt to slots of bounded size and stored in a table bucketed by slot: later steps meet a slot's rows
   and what other tasks say about them without moving the text again.
2. Copies of a text with a smaller id are set aside: all their windows are earlier in that row.
3. Slots send their distinct minimizers to be counted; those that occur twice or more come back.
4. Segments (runs of windows with one such minimizer) go to shards by minimizer, distinct ones per
   slot with their earliest place. Windows of very frequent minimizers go one by one, by their own hash.
5. A shard's solver answers with one bit per window: does it occur earlier than the segment's own earliest place?
6. Slots turn the bits into removed units.

A group of copies or a common passage costs each slot one segment, whatever its number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.llm.columns import text_steps
from tallyframe.llm.words import BYTE_BASE, WORD_BASE, mix, prefix, word_hashes, word_spans
from tallyframe.plans.durable import durable, scratch

#: Bytes of text per slot, and per step inside a task.
SLOT_BYTES, STEP = 8 << 20, 1 << 19
#: Minimizers with more occurrences than this are split by window.
FREQUENT = 20_000
#: Bytes of segments that a shard's solver works on at once.
SOLVE_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
_INFO = "slot int, kind int, part int, a binary, b binary"

#: Marks per window of the given texts: solver(data, text offsets, ids, places, spec) -> bool per window.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "Spec"], np.ndarray]


@dataclass(frozen=True)
class Spec:
    k: int  # units of a window
    m: int  # units of a minimizer
    words: bool  # units are words; else bytes
    within: bool  # an earlier place in the same document counts too


@dataclass
class Units:
    """The units of some documents: values to hash, byte span of each, first unit of every document."""

    values: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    base: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, words: bool) -> Units:
        if not words:
            at = np.arange(len(data) + 1)
            return cls(data, at[:-1], at[1:], offsets, BYTE_BASE)
        starts, ends, firsts = word_spans(data, offsets)
        return cls(word_hashes(data, starts, ends), starts, ends, firsts, WORD_BASE)


@dataclass
class Segments:
    """Runs of windows with one minimizer: first unit, windows, minimizer, content hash, byte span, document."""

    first: np.ndarray
    n: np.ndarray
    key: np.ndarray
    content: np.ndarray
    byte: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    place: np.ndarray  # first unit, counted in its document


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments(u: Units, spec: Spec) -> Segments:
    n, k, m = len(u.values), spec.k, spec.m
    if n < k:
        return Segments(*[np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)])
    sums = prefix(u.values, u.base)
    inverse = powers_inverse(u.base, n)
    hashes = mix((sums[m:] - sums[:-m]) * inverse[: n - m + 1])
    bits = np.uint64(max(20, n.bit_length()))
    ordered = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    owner = (sliding_min(ordered, k - m + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    length = np.diff(u.firsts)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one document
    has = length >= k
    np.add.at(inside, u.firsts[:-1][has], 1)
    np.add.at(inside, u.firsts[1:][has] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: n - k + 1]) > 0)
    if not len(at):
        return segments(Units(u.values[:0], u.starts[:0], u.ends[:0], u.firsts[:1], u.base), spec)
    owner = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = owner[1:] != owner[:-1]
    run = np.flatnonzero(new)
    first, count = at[run], np.diff(np.append(run, len(at)))
    return described(u, sums, first, count, mix(hashes[owner[run]] + np.uint64(1)) >> np.uint64(16), spec)


def powers_inverse(base: int, n: int) -> np.ndarray:
    from tallyframe.llm.words import powers

    return powers(base, n + 1)[1]


def described(u: Units, sums: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, spec: Spec) -> Segments:
    last = first + count + spec.k - 1
    content = mix((sums[last] - sums[first]) * powers_inverse(u.base, len(u.values))[first] + count.astype(np.uint64))
    doc = np.searchsorted(u.firsts, first, "right") - 1
    return Segments(first, count, key, content, u.starts[first], u.ends[last - 1] - u.starts[first], doc, first - u.firsts[doc])


def by_window(u: Units, s: Segments, spec: Spec) -> Segments:
    """Every window of ``s`` as a segment of its own, owned by its own hash."""
    start = np.repeat(s.first - np.concatenate([[0], np.cumsum(s.n)[:-1]]), s.n) + np.arange(s.n.sum())
    out = described(u, prefix(u.values, u.base), start, np.ones(len(start), np.int64), np.zeros(len(start), np.uint64), spec)
    out.key = mix(out.content + np.uint64(3)) >> np.uint64(16)
    return out


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


@dataclass
class Slot:
    """A slot's rows in the order of their row numbers, and what other tasks sent about them."""

    ids: np.ndarray
    rows: pa.Table
    copy: np.ndarray
    repeated: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bits: dict[int, bytes] = field(default_factory=dict)

    @classmethod
    def of(cls, left: pa.Table, right: pa.Table) -> Slot:
        left = left.take(pa.array(np.argsort(left.column("rid").to_numpy(), kind="stable")))
        ids = left.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
        slot = cls(ids, left, np.zeros(len(ids), bool))
        rid = left.column("rid").to_numpy()
        again, often = [], []
        for r in right.to_pylist():
            if r["kind"] == 0:
                slot.copy |= np.isin(rid, np.frombuffer(r["a"], "<i8"))
            elif r["kind"] == 1:
                keys = unpack48(r["a"])
                hot = np.frombuffer(r["b"], np.uint8).astype(bool)
                again.append(keys)
                often.append(keys[hot])
            else:
                slot.bits[r["part"]] = r["a"]
        if again:
            slot.repeated, slot.frequent = np.sort(np.concatenate(again)), np.sort(np.concatenate(often))
        return slot

    def steps(self, spec: Spec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Units]]:
        for first, end, data, offsets in text_steps(self.rows.column("text").combine_chunks(), STEP):
            yield first, end, data, offsets, Units.of(data, offsets, spec.words)

    def wanted(self, spec: Spec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Units, Segments]]:
        """Per step, the segments whose minimizer was seen elsewhere too."""
        for first, end, data, offsets, u in self.steps(spec):
            s = segments(u, spec)
            own = ~self.copy[first:end][s.doc]
            often = own & member(s.key, self.frequent)
            s, hot = pick(s, own & member(s.key, self.repeated) & ~often), pick(s, often)
            if len(hot.n):
                s = joined([s, by_window(u, hot, spec)])
            yield first, end, data, offsets, u, s


def member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def pick(s: Segments, mask: np.ndarray) -> Segments:
    return Segments(*[getattr(s, f)[mask] for f in s.__dataclass_fields__])


def joined(parts: list[Segments]) -> Segments:
    return Segments(*[np.concatenate([getattr(s, f) for s in parts]) for f in Segments.__dataclass_fields__])


def spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, end to end."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
    return data[shift + np.arange(int(sizes.sum()))]


@dataclass
class Distinct:
    """Distinct segments of a slot by part, each with its earliest place; ``which`` maps occurrences to them."""

    which: np.ndarray
    earliest: np.ndarray  # occurrence number of each distinct segment
    part: np.ndarray


def distinct(s: Segments, ids: np.ndarray, parts: int) -> Distinct:
    """Numbered by (part, key, content); ids are those of the occurrences' documents."""
    part = (s.key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((s.place, ids, s.content, s.key, part))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (s.key[a] != s.key[b]) | (s.content[a] != s.content[b])
    which = np.zeros(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    earliest = order[new]
    return Distinct(which, earliest, part[earliest])


def store(df: DataFrame, text: str, doc_id: str, keep: tuple[str, ...] = (), slot_bytes: int | None = None) -> tuple[DataFrame, int]:
    """The rows dealt to slots in a table bucketed by slot, in the shared folder, and the number of slots.

    Slots hold about ``SLOT_BYTES``, and there are at least as many as shuffle partitions unless ``slot_bytes`` is given. The catalog
    forgets the table at once: the returned rows keep its files and buckets, other sessions never see its name.
    """
    spark = df.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    total = df.agg(F.sum(F.octet_length(t)).alias("n")).first()[0] or 0
    floor = 1 if slot_bytes else int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(-(-total // (slot_bytes or SLOT_BYTES)), floor, 1)
    buckets = min(slots, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    rid = F.monotonically_increasing_id()
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), rid.alias("rid"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int"))
    name = f"slots_{uuid.uuid4().hex}"
    rows.repartition(buckets, "slot").write.options(compression="zstd", path=scratch(spark, "slots")).bucketBy(buckets, "slot").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # an external one: its files stay
    return stored, slots


def copies(stored: DataFrame) -> DataFrame:
    """Info rows naming the rows whose whole text a smaller id has too; null ids count as larger than all."""
    d = F.coalesce("doc_id", F.lit(NO_ID))
    rows = stored.select("slot", "rid", d.alias("d"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    rows = durable(rows, "digests")
    least = durable(rows.groupBy("k1", "k2").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "least")
    later = rows.join(least, ["k1", "k2"]).filter("d > least").select("slot", "rid")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(slot, kind="stable")
            names, first = np.unique(slot[order], return_index=True)
            blobs = [x.astype("<i8").tobytes() for x in np.split(rid[order], first[1:])] if len(names) else []
            yield info(names, 0, np.zeros(len(names)), blobs, [b""] * len(blobs))

    return later.mapInArrow(packed, _INFO)


def info(slot, kind: int, part, a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(slot, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(part, np.int32)), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
        ["slot", "kind", "part", "a", "b"],
    )


def per_slot(stored: DataFrame, told: DataFrame, work: Callable[[int, Slot], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Run ``work`` on every slot with what was told about it; only the told rows are shuffled."""
    empty = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(key[0].as_py(), Slot.of(left, right)) if left.num_rows else None
        if out is None:
            from pyspark.sql.pandas.types import to_arrow_schema

            return to_arrow_schema(empty).empty_table()
        return pa.Table.from_batches([out])

    return stored.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(run, schema)


def minimizer_counts(stored: DataFrame, told: DataFrame, spec: Spec, parts: int) -> DataFrame:
    def work(slot: int, s: Slot) -> pa.RecordBatch | None:
        seen = [np.zeros(0, np.uint64)]
        for first, end, _, _, u in s.steps(spec):
            seg = segments(u, spec)
            seen.append(seg.key[~s.copy[first:end][seg.doc]])
        keys, n = np.unique(np.concatenate(seen), return_counts=True)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order].astype("<u4"), part[order]
        names, at = np.unique(part, return_index=True)
        cut = [*at, len(part)]
        return info(np.full(len(names), slot), 1, names, [pack48(keys[x:y]) for x, y in zip(cut, cut[1:])], [n[x:y].tobytes() for x, y in zip(cut, cut[1:])])

    return per_slot(stored, told, work, _INFO)


def repeated_minimizers(counts: DataFrame, parts: int) -> DataFrame:
    """For every slot, those of its minimizers that occur twice or more anywhere, the very frequent ones marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, keys, counts_ = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                own = unpack48(r["a"])
                keys.append(own)
                counts_.append(np.frombuffer(r["b"], "<u4"))
                slots.append(np.full(len(own), r["slot"], np.int32))
        if not keys:
            return
        slot, key, n = np.concatenate(slots), np.concatenate(keys), np.concatenate(counts_).astype(np.int64)
        order = np.argsort(key, kind="stable")
        slot, key, n = slot[order], key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key))))
        twice = total > 1
        slot, key, hot = slot[twice], key[twice], total[twice] > FREQUENT
        order = np.argsort(slot, kind="stable")
        slot, key, hot = slot[order], key[order], hot[order]
        names, at = np.unique(slot, return_index=True)
        cut = [*at, len(slot)]
        for x, y, name in zip(cut, cut[1:], names):
            yield info([name], 1, [0], [pack48(key[x:y])], [hot[x:y].astype(np.uint8).tobytes()])

    return counts.repartition(parts, "part").mapInArrow(run, _INFO)


_SENT = "slot int, part int, n int, text binary, sizes binary, ids binary, places binary, keys binary"


def sent_segments(stored: DataFrame, told: DataFrame, spec: Spec, parts: int) -> DataFrame:
    def work(slot: int, s: Slot) -> pa.RecordBatch | None:
        found, texts, base = [], [], 0
        for first, _, data, _, _, seg in s.wanted(spec):
            texts.append(spans(data, seg.byte, seg.size))
            seg.byte = base + np.concatenate([[0], np.cumsum(seg.size)[:-1]]).astype(np.int64) if len(seg.n) else seg.byte
            base += int(seg.size.sum())
            seg.doc = seg.doc + first
            found.append(seg)
        if not base:
            return None
        seg, text = joined(found), np.concatenate(texts)
        d = distinct(seg, s.ids[seg.doc], parts)
        own = pick(seg, d.earliest)
        names, at = np.unique(d.part, return_index=True)
        cut, out = [*at, len(d.part)], []
        for x, y, name in zip(cut, cut[1:], names):
            out.append(
                (
                    slot,
                    int(name),
                    y - x,
                    spans(text, own.byte[x:y], own.size[x:y]).tobytes(),
                    own.size[x:y].astype("<u4").tobytes(),
                    s.ids[own.doc[x:y]].astype("<i8").tobytes(),
                    own.place[x:y].astype("<i8").tobytes(),
                    pack48(own.key[x:y]),
                )
            )
        cols = list(zip(*out))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in _SENT.split(", ")])

    return per_slot(stored, told, work, _SENT)


def solved(sent: DataFrame, spec: Spec, parts: int, solver: Solver) -> DataFrame:
    """Bits per (slot, part): one per window of its segments, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by_part.setdefault(r["part"], []).append(r)
        for part in list(by_part):
            rows = by_part.pop(part)
            size = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in rows]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
            places = np.concatenate([np.frombuffer(r["places"], "<i8") for r in rows])
            keys = np.concatenate([unpack48(r["keys"]) for r in rows])
            text = np.concatenate([np.frombuffer(r["text"], np.uint8) for r in rows])
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            groups = -(-int(size.sum()) // SOLVE_BYTES)
            lot = (mix(keys) % np.uint64(groups)).astype(np.int64)  # equal minimizers stay together
            marks: list[np.ndarray | None] = [None] * len(size)
            for g in range(groups):
                which = np.flatnonzero(lot == g)
                if not len(which):
                    continue
                offsets = np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64)
                data = spans(text, begin[which], size[which])
                flags = solver(data, offsets, ids[which], places[which], spec)
                n = np.diff(Units.of(data, offsets, spec.words).firsts) - spec.k + 1
                for i, f in zip(which, np.split(flags, np.cumsum(n)[:-1])):
                    marks[i] = f
            at = 0
            for r in rows:
                bits = np.packbits(np.concatenate(marks[at : at + r["n"]])).tobytes()
                at += r["n"]
                yield info([r["slot"]], 2, [part], [bits], [b""])

    return sent.repartition(parts, "part").mapInArrow(run, _INFO)


def removed_units(s: Slot, spec: Spec, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Units, np.ndarray]]:
    """Per step of a slot, which units are covered by a window that occurs earlier."""
    found = []
    for first, *_, seg in s.wanted(spec):
        seg.doc = seg.doc + first
        found.append(seg)
    seg = joined(found) if found else None
    flags: list[np.ndarray] = []
    if seg is not None and len(seg.n):
        d = distinct(seg, s.ids[seg.doc], parts)
        n = seg.n[d.earliest]
        bits = np.zeros(int(n.sum()), bool)
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        for part in np.unique(d.part):
            x, y = np.searchsorted(d.part, [part, part + 1])
            lo, hi = at[x], at[y]
            bits[lo:hi] = np.unpackbits(np.frombuffer(s.bits[int(part)], np.uint8))[: hi - lo]
        # The earliest place of a distinct segment keeps what no other segment has earlier; every later place goes.
        e = d.earliest[d.which]
        later = s.ids[seg.doc] > s.ids[seg.doc[e]]
        if spec.within:
            later |= (s.ids[seg.doc] == s.ids[seg.doc[e]]) & (seg.place > seg.place[e])
        index = np.repeat(at[d.which] - np.concatenate([[0], np.cumsum(seg.n)[:-1]]), seg.n) + np.arange(seg.n.sum())
        window = np.repeat(seg.first - np.concatenate([[0], np.cumsum(seg.n)[:-1]]), seg.n) + np.arange(seg.n.sum())
        hit = bits[index] | np.repeat(later, seg.n)
        cuts = np.cumsum([int(f.n.sum()) for f in found])[:-1]
        flags = [w[h] for w, h in zip(np.split(window, cuts), np.split(hit, cuts))]
    else:
        flags = [np.zeros(0, np.int64) for _ in found]
    for (first, end, data, offsets, u), hit in zip(s.steps(spec), flags):
        edge = np.zeros(len(u.values) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + spec.k, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i in np.flatnonzero(s.copy[first:end]):
            x, y = u.firsts[i], u.firsts[i + 1]
            if y - x >= spec.k:
                gone[x:y] = True
        yield first, end, data, offsets, u, gone


def without_repeats(
    df: DataFrame,
    spec: Spec,
    solver: Solver,
    render: Callable[[Slot, Iterator], pa.RecordBatch],
    schema: T.StructType,
    text: str,
    doc_id: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Run all steps; ``render`` makes a slot's result rows from the removed units."""
    stored, slots = store(df, text, doc_id, keep)
    parts = slots
    copied = durable(copies(stored), "copies")
    again = durable(repeated_minimizers(minimizer_counts(stored, copied, spec, parts), parts), "repeated")
    told = copied.union(again)
    bits = durable(solved(sent_segments(stored, told, spec, parts), spec, parts, solver), "bits")
    return per_slot(stored, told.union(bits), lambda slot, s: render(s, removed_units(s, spec, parts)), schema)
