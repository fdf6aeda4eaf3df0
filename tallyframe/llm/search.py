"""The best documents of a corpus for a set of queries, by bit-sliced signatures and exact rescoring.

Method: every document is a column of a block of bit slices, a Bloom signature of its terms. A term is entered
once per level of occurrences it reaches (1, 2, 3, 5, 9), so the slices of a term, and-ed, name all
documents that hold it and some that do not, and how often at most. Weighted sums over a query's slices are upper
bounds of the scores. The documents with the highest bounds are scored exactly; the tenth best of their scores is
a floor, and every document whose bound reaches its query's floor is scored exactly from its text. What is left out
has provably too low a score, so the ranking is exact.

Documents of like size share a block, whose slices are as many as its largest one needs. Blocks are stored; queries
meet them in groups of bounded size. Terms are counted over the whole corpus.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from tallyframe.llm.words import mix
from tallyframe.plans.durable import durable

#: Results per query, and documents with the highest bounds that are scored to find a query's floor.
BEST, FIRST = 10, 100
#: A term is entered at each of these numbers of occurrences that it reaches ...
LEVELS = (1, 2, 3, 5, 9)
#: ... so a document that misses the next level has at most this many; None: any number.
AT_MOST = (1, 2, 4, 8, None)
#: Slices per entry and bits set for it; the number of slices is a power of two within these bounds.
SLICES_PER_ENTRY, PROBES, LEAST_SLICES, MOST_SLICES = 16, 5, 64, 1 << 21
#: Documents of a block, and bits of a block while it is made.
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 23
#: Bytes of text indexed at once, and bytes of a text split into terms at once.
STEP_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Bytes of blocks that meet queries in one group, and query terms of one group.
GROUP_BYTES, GROUP_TERMS = 8 << 20, 1 << 15
#: Term presences looked at together.
CELLS = 1 << 20

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEEP else 0x20 for c in range(256))
_INDEX = "term string, n long, slices int, docs int, terms long, ids binary, no_id binary, k1 binary, k2 binary, lengths binary, bits binary"
_FOUND = "query long, doc_id long, k1 long, k2 long, bound double"


def terms_of(text: Column) -> Column:
    """Terms with A-Z lower-cased: runs of digits, letters and characters beyond ASCII; null has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _SEPARATORS), "")


def text_key(text: Column) -> tuple[Column, Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(7), t)


def counted(raw: bytes) -> Counter[bytes]:
    """The same terms, of the text's bytes; a long text goes piece by piece."""
    low, out, at = raw.translate(_FOLD), Counter(), 0
    while at < len(low):
        end = low.find(b" ", at + PIECE_BYTES)
        end = len(low) if end < 0 else end
        out.update(low[at:end].split())
        at = end
    return out


def slices(hashes: np.ndarray, level: int, width: int) -> list[np.ndarray]:
    """The slices of each term hash at a level, for blocks of ``width`` slices (a power of two)."""
    out = []
    for probe in range(PROBES):
        if probe % 3 == 0:  # three slice numbers to a hash
            h = mix(hashes.astype(np.uint64) + np.uint64((level * PROBES + probe) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out.append(((h >> np.uint64(21 * (probe % 3))) & np.uint64(width - 1)).astype(np.int64))
    return out


def term_hash(term: bytes) -> int:
    """The signed value that the SQL function xxhash64 gives for the term."""
    h = xxhash.xxh64_intdigest(term, 42)
    return h - (1 << 64) if h >> 63 else h


class _Step:
    """Documents on their way into blocks."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.docs: list[tuple] = []  # (doc_id, k1, k2, number of terms)
        self.term: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, k1: int, k2: int, raw: bytes) -> None:
        c = counted(raw)
        self.bytes += len(raw)
        if not c:
            return
        known = self.known
        self.term.append(np.array([known.setdefault(t, len(known)) for t in c], np.int32))
        self.times.append(np.fromiter(c.values(), np.int64, len(c)).clip(max=LEVELS[-1]).astype(np.int8))
        self.docs.append((doc_id, k1, k2, c.total()))

    def counts(self) -> tuple[list[bytes], np.ndarray]:
        """The terms and how many documents hold them."""
        return list(self.known), np.bincount(np.concatenate(self.term), minlength=len(self.known)) if self.term else np.zeros(0, np.int64)

    def blocks(self) -> Iterator[dict]:
        if not self.docs:
            return
        hashes = np.array([term_hash(t) for t in self.known], np.int64)
        sizes = np.array([len(t) for t in self.term])
        doc, term, times = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.term), np.concatenate(self.times)
        entries = sum(np.bincount(doc[times >= level], minlength=len(sizes)) for level in LEVELS)
        width = (1 << np.ceil(np.log2(np.maximum(entries * SLICES_PER_ENTRY, 1))).astype(np.int64)).clip(LEAST_SLICES, MOST_SLICES)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            most = max(8, min(BLOCK_DOCS, BLOCK_BITS // w))
            for at in range(0, len(own), most):
                yield self.block(own[at : at + most], w, hashes, term, times, firsts)

    def block(self, own: np.ndarray, width: int, hashes: np.ndarray, term: np.ndarray, times: np.ndarray, firsts: np.ndarray) -> dict:
        bits = np.zeros((width, len(own)), bool)
        size = firsts[own + 1] - firsts[own]
        column = np.repeat(np.arange(len(own)), size)
        at = np.repeat(firsts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        for number, level in enumerate(LEVELS):
            has = times[at] >= level
            for s in slices(hashes[term[at[has]]], number, width):
                bits[s, column[has]] = True
        ids, k1, k2, n = zip(*[self.docs[i] for i in own.tolist()])
        blob = lambda x: np.array(x, "<i8").tobytes()
        return {
            "slices": width, "docs": len(own), "terms": sum(n), "ids": blob([i or 0 for i in ids]), "no_id": np.packbits([i is None for i in ids]).tobytes(),
            "k1": blob(k1), "k2": blob(k2), "lengths": blob(n), "bits": np.packbits(bits, axis=1).tobytes(),
        }


@dataclass
class Index:
    """Stored blocks of signatures, documents per term, documents with a term and all their terms."""

    blocks: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build_index(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Every document that holds a term, in stored blocks; documents without terms cannot be found and are left out."""
    k1, k2 = text_key(F.col(text))
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = T._parse_datatype_string(_INDEX)
    arrow = to_arrow_schema(schema)

    def told(step: _Step) -> Iterator[pa.RecordBatch]:
        for block in step.blocks():
            yield pa.RecordBatch.from_pylist([block], schema=arrow)
        terms, n = step.counts()
        rest = [pa.nulls(len(n), t) for t in arrow.types[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(arrow.types[0]), pa.array(n, pa.int64()), *rest], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _Step()
        for b in batches:
            ids, k1, k2 = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                step.add(ids[i], k1[i], k2[i], b.column(3)[i].as_py() or b"")
                if step.bytes >= STEP_BYTES:
                    yield from told(step)
                    step = _Step()
        yield from told(step)

    made = durable(source.mapInArrow(run, schema), "signatures")
    blocks = made.filter("term is null").drop("term", "n")
    sums = blocks.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    counts = durable(made.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    return Index(blocks, counts, int(sums.docs or 0), int(sums.terms or 0))


def weighted(index: Index, queries: DataFrame) -> DataFrame:
    """(query, term, w) of every query's terms that some document holds, once each; queries has (query, text)."""
    terms = queries.select("query", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    w = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs + 2)) / (2 * F.col("df") + 1)))
    return terms.join(index.frequencies, "term").select("query", "term", w.cast("long").alias("w"))


def length_factor(n_terms, index: Index):
    """What stands for a document's length in the scores, from its number of terms (numpy or a Python int)."""
    return 10 + 90 * n_terms * index.n_docs // index.n_terms


def gains(m: np.ndarray) -> list[np.ndarray]:
    """What reaching each level adds to the bound of a term of weight 1, by document."""
    top = [np.full(len(m), 1e6) if t is None else 1e9 * t / (1000.0 * t + 8 * m) for t in AT_MOST]
    return [top[0], *[b - a for a, b in zip(top, top[1:])]]


def bounds(block: dict, hashes: np.ndarray, index_size: tuple[int, int]) -> Iterator[tuple[slice, np.ndarray]]:
    """(documents, their bound per term of weight 1): upper bounds of every term in every document of a block.

    As many documents at once as keep terms x documents under ``CELLS``.
    """
    docs, width = block["docs"], block["slices"]
    bits = np.frombuffer(block["bits"], np.uint8).reshape(width, -1)
    m = 10 + 90 * np.frombuffer(block["lengths"], "<i8") * index_size[0] // index_size[1]
    rows = []
    for number in range(len(LEVELS)):
        both = functools.reduce(np.bitwise_and, (bits[s] for s in slices(hashes, number, width)))
        rows.append(both & rows[-1] if rows else both)  # a level counts only where the one below is reached
    step = max(8, CELLS // max(len(hashes), 1) // 8 * 8)
    for first in range(0, docs, step):
        end = min(first + step, docs)
        out = np.zeros((len(hashes), end - first))
        for row, gain in zip(rows, gains(m[first:end])):
            some = np.flatnonzero(row[:, first // 8 : -(-end // 8)].any(axis=1))
            out[some] += np.unpackbits(row[some, first // 8 : -(-end // 8)], axis=1)[:, : end - first] * gain
        yield slice(first, end), out


def _upper(bound: np.ndarray) -> np.ndarray:
    """Rounded up past what sums of doubles can lose."""
    return bound * (1 + 1e-9) + 1


def meet(index: Index, terms: DataFrame, floors: DataFrame | None) -> DataFrame:
    """(query, doc_id, k1, k2, bound) of the documents a query's bounds do not rule out.

    Without floors: per group of blocks the ``FIRST`` highest bounds of each query. With floors (query, floor): every document
    whose bound reaches its query's; of equal texts in a block the ``BEST`` least ids, as no other can be among
    the best. Groups hold some ``GROUP_BYTES`` of blocks and ``GROUP_TERMS`` query terms, so queries are sent once per
    group of blocks and blocks once per group of queries.
    """
    size = index.blocks.agg(F.sum(F.length("bits") + 32 * F.col("docs")).alias("n")).first().n or 0
    deals = max(1, -(-int(size) // GROUP_BYTES))
    packs = max(1, -(-terms.count() // GROUP_TERMS))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = index.blocks.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(deals)).cast("int")).select("*", spread(packs, "pack"))
    asked = terms.select("query", F.xxhash64("term").alias("hash"), "w", F.pmod(F.xxhash64("query"), F.lit(packs)).cast("int").alias("pack"))
    asked = asked.join(floors, "query") if floors is not None else asked.withColumn("floor", F.lit(0).cast("long"))
    right = asked.select("*", spread(deals, "deal"))
    counts, all_of = (index.n_docs, index.n_terms), floors is not None
    arrow = to_arrow_schema(T._parse_datatype_string(_FOUND))

    def run(key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return arrow.empty_table()
        a = {c: asked.column(c).to_numpy() for c in ("query", "hash", "w", "floor")}
        hashes, term = np.unique(a["hash"], return_inverse=True)
        order = np.argsort(a["query"], kind="stable")
        names, first = np.unique(a["query"][order], return_index=True)
        each = [(int(q), term[rows], a["w"][rows].astype(float), int(a["floor"][rows[0]])) for q, rows in zip(names, np.split(order, first[1:]))]
        kept: list[list[np.ndarray]] = [[] for _ in each]  # rows of (id, k1, k2) and bounds, per query
        for block in (blocks.slice(i, 1).to_pylist()[0] for i in range(blocks.num_rows)):
            who = [np.frombuffer(block[c], "<i8") for c in ("ids", "k1", "k2")]
            no_id = np.unpackbits(np.frombuffer(block["no_id"], np.uint8))[: block["docs"]].astype(bool)
            for part, unit in bounds(block, hashes, counts):
                here = [x[part] for x in (*who, no_id)]
                for out, (_, t, w, floor) in zip(kept, each):
                    bound = _upper(w @ unit[t])
                    if all_of:
                        at = least_ids(np.flatnonzero(bound >= max(floor, 2)), here)
                    else:
                        at = np.argpartition(-bound, min(FIRST, len(bound)) - 1)[:FIRST]
                        at = at[bound[at] >= 2]
                    if len(at):
                        out.append(np.rec.fromarrays([*[x[at] for x in here], bound[at]]))
                    if not all_of and len(out) > 8:
                        out[:] = [highest(out)]
        found = [(q, highest(out) if not all_of else np.concatenate(out)) for (q, *_), out in zip(each, kept) if out]
        if not found:
            return arrow.empty_table()
        rec = np.concatenate([r for _, r in found])
        columns = [np.repeat([q for q, _ in found], [len(r) for _, r in found]), pa.array(rec["f0"], mask=rec["f3"]), rec["f1"], rec["f2"], rec["f4"]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return left.groupBy("deal", "pack").cogroup(right.groupBy("deal", "pack")).applyInArrow(run, _FOUND)


def highest(parts: list[np.ndarray]) -> np.ndarray:
    rec = np.concatenate(parts)
    return rec[np.argsort(-rec["f4"], kind="stable")[:FIRST]]


def least_ids(at: np.ndarray, here: list[np.ndarray]) -> np.ndarray:
    """Of the documents ``at``, the ``BEST`` with the least ids of each text; no id counts as the largest."""
    if len(at) <= BEST:
        return at
    ids, k1, k2, no_id = (x[at] for x in here)
    order = np.lexsort((ids, no_id, k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return at[order[np.arange(len(order)) - start < BEST]]


def exact_scores(index: Index, found: DataFrame, terms: DataFrame, df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(query, k1, k2, score) of every found (query, text) from the text itself, each text scored once."""
    pairs = durable(found.select("query", "k1", "k2").distinct(), "pairs")
    # One row of each text is looked up, by its least found id, so a large group of copies stays spread.
    no_id = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    wanted = durable(found.groupBy("k1", "k2").agg(F.min(no_id).alias("d")), "wanted")
    k1, k2 = text_key(F.col(text))
    rows = df.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.col(text).cast("string").alias("text"))
    texts = rows.join(wanted, ["k1", "k2", "d"], "left_semi").dropDuplicates(["k1", "k2"])
    split = texts.select("k1", "k2", terms_of(F.col("text")).alias("t"))
    m = F.expr(f"10 + (90 * cast(size(t) as bigint) * {index.n_docs}) div {index.n_terms}")
    held = split.select("k1", "k2", m.alias("m"), F.explode("t").alias("term")).groupBy("k1", "k2", "m", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = pairs.join(terms, "query")
    return asked.join(held, ["k1", "k2", "term"]).groupBy("query", "k1", "k2").agg(F.expr("sum(w * ((1000000000 * tf) div (1000 * tf + 8 * m)))").alias("score"))


def best_documents(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``BEST`` documents with a score above 0, equal scores by least doc_id.

    Every row of ``df`` is a document: repeated rows are ranked next to each other, rows without id after the others of
    their score, null and wordless texts never. A distinct (item_id, text) is one item, a null item_id included;
    items without terms that a document holds have no rows. Empty tables give an empty result, other columns
    are not read. No row is left out but by its bound: see the module text.
    """
    queries = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    queries = durable(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    index = build_index(df, text, doc_id)
    if not index.n_docs:
        return queries.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    terms = durable(weighted(index, queries), "query-terms")
    ordered = W.partitionBy("query").orderBy(F.desc("bound"), "k1", "k2")
    first = durable(meet(index, terms, None).withColumn("r", F.row_number().over(ordered)).filter(F.col("r") <= FIRST).drop("r"), "first")
    scored = first.join(exact_scores(index, first, terms, df, text, doc_id), ["query", "k1", "k2"]).filter("score > 0")
    tenth = scored.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("r") == BEST)
    floors = terms.select("query").distinct().join(tenth.select("query", "score"), "query", "left")
    floors = durable(floors.select("query", F.coalesce("score", F.lit(0)).alias("floor")), "floors")
    found = durable(meet(index, terms, floors), "found")
    scores = exact_scores(index, found, terms, df, text, doc_id).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.join(scores, ["query", "k1", "k2"]).withColumn("rank", rank).filter(F.col("rank") <= BEST)
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
