"""Near duplicates by DartMinHash over weighted word shingles.

Method: a document is a weighted set of five-word shingles, the weight being how often it occurs. Every
element throws darts, determined by hashes alone, into its weight region; darts arrive in order of
rank at one per unit of weight, each at one of K coordinates, and only darts up to a rank that gives each
coordinate some dart are thrown, so the cost follows the set's size plus K log K, not their product. The earliest dart of
each coordinate is the signature: two sets agree on a coordinate with their weighted Jaccard similarity. Bands
of the signature are joined and every candidate is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.llm.columns import text_steps, with_text
from tallyframe.llm.components import components
from tallyframe.llm.words import WORD_BASE, mix, prefix, span_hashes, windows, word_hashes, word_spans
from tallyframe.plans.durable import durable

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 4 darts: a pair of similarity 0.8 shares a band with probability 1 - 3e-6.
BANDS, ROWS = 24, 4
#: Bytes of text whose shingles and darts a task holds at once.
STEP = 1 << 19
#: Star rounds with new leaders before the members of keys that still hold several classes are compared in blocks.
ROUNDS = 2
#: Members of a block, and bytes of their cells; two blocks are compared in one task.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Cells that a product of two blocks takes at once.
_WIDE = 2048


def shingle_cells(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every unit of weight: the u-th occurrence of a shingle is a cell of its own.

    With such cells weighted Jaccard similarity is plain Jaccard similarity. A document of fewer
    words than ``size``, but not none, has its word sequence as its one shingle.
    """
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    at, hashes = windows(words, firsts, size)
    doc = np.searchsorted(firsts, at, "right") - 1
    count = np.diff(firsts)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        sums = prefix(words, WORD_BASE)
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, span_hashes(sums, firsts[short], firsts[short + 1], WORD_BASE)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(doc)) - np.repeat(run, np.diff(np.append(run, len(doc))))
    return doc, np.where(nth > 0, mix(hashes + nth.astype(np.uint64) * np.uint64(WORD_BASE)), hashes)


def signatures(doc: np.ndarray, cells: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Earliest dart of every coordinate for each document (0 where it has no cells)."""
    out = np.zeros((n_docs, k), np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    open_ = weight > 0
    reach = k * (math.log(k) + 3)  # expected darts per document
    while open_.any():
        live = open_[doc]
        d, cell = doc[live], cells[live]
        limit = (reach / np.maximum(weight, 1))[d]  # by rank
        rank, found, throw = np.zeros(len(d)), [], 1
        while len(d):
            h = mix(cell + np.uint64(throw * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            hit = rank <= limit
            d, cell, rank, limit, h = d[hit], cell[hit], rank[hit], limit[hit], h[hit]
            found.append((d, rank, mix(h + np.uint64(1))))
            throw += 1
        d, rank, dart = (np.concatenate(x) for x in zip(*found))
        late_first = np.argsort(-rank, kind="stable")
        slot = d * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        flat, seen = np.zeros(n_docs * k, np.uint64), np.zeros(n_docs * k, bool)
        flat[slot[late_first]] = dart[late_first]  # the earliest is written last
        seen[slot] = True
        full = open_ & seen.reshape(n_docs, k).all(axis=1)
        out[full] = flat.reshape(n_docs, k)[full]
        open_ &= ~full
        reach *= 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(WORD_BASE) + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def signed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, two digests of the text, the number of shingles and the band keys (null without words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), t.alias("__t"))
    schema = T.StructType(
        [keyed.schema[c] for c in ("doc_id", "k1", "k2")]
        + [T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_steps(batch.column(3), STEP):
                doc, cells = shingle_cells(data, offsets)
                n = np.bincount(doc, minlength=end - first)
                keys = band_keys(signatures(doc, cells, end - first)).view(np.int64)
                has = n > 0
                at = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].reshape(-1)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns[:3], pa.array(n.astype(np.int64)), bands], schema.names
                )

    return keyed.mapInArrow(run, schema)


def shingle_lists(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the sorted cells of ``__text`` as packed 64-bit numbers."""
    keep = list(keep)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_steps(batch.column(len(keep)), STEP):
                doc, cells = shingle_cells(data, offsets)
                cells = cells[np.lexsort((cells, doc))]
                cut = np.searchsorted(doc, np.arange(end - first + 1))
                packed = pa.array([cells[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[: len(keep)], packed], schema.names)

    return with_text(df, "__text", keep).mapInArrow(run, schema)


def similar(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity reaches the threshold, with it."""
    left = lists.select(F.col("nid").alias("a"), F.col("cells").alias("ca"))
    right = lists.select(F.col("nid").alias("b"), F.col("cells").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    value[i] = both / (len(x) + len(y) - both)
            hit = np.flatnonzero(value >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit)), pa.array(value[hit])], ["a", "b", "similarity"])

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ca", "cb")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def spanning_links(nids: np.ndarray, roots: np.ndarray, lists: list[np.ndarray], blocks: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what exact similarity connects between two blocks of members, or inside one.

    Shared cells are counted for all pairs of the two blocks by products of 0/1 matrices, some thousand cells at a
    time; cells that only one member has cannot be shared and are left out. At most one link per class joined.
    """
    size = np.array([len(x) for x in lists])
    _, cell, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(lists)), size)
    shared = count[cell] > 1
    number = np.cumsum(count > 1) - 1
    cell, member = number[cell[shared]], member[shared]
    order = np.argsort(cell, kind="stable")
    cell, member = cell[order], member[order]
    upper = np.flatnonzero(blocks == blocks.max())
    lower = np.flatnonzero(blocks == blocks.min())  # the same members where there is one block
    row = np.zeros(len(lists), np.int64)
    row[lower] = np.arange(len(lower))
    if len(upper) < len(lists):
        row[upper] = np.arange(len(upper))
    is_upper = blocks == blocks.max()
    is_lower = blocks == blocks.min()
    both = np.zeros((len(upper), len(lower)), np.float32)
    for first in range(0, int((count > 1).sum()), _WIDE):
        a, b = np.searchsorted(cell, [first, first + _WIDE])
        sides = []
        for own, n in ((is_upper, len(upper)), (is_lower, len(lower))):
            have = np.zeros((n, _WIDE), np.float32)
            at = own[member[a:b]]
            have[row[member[a:b][at]], cell[a:b][at] - first] = 1
            sides.append(have)
        both += sides[0] @ sides[1].T
    top = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    out = []
    for i, u in enumerate(upper):
        near = both[i] >= (threshold - 1e-12) * (size[u] + size[lower] - both[i])
        for j in lower[near & (roots[lower] != roots[u])]:
            x, y = find(int(roots[u])), find(int(roots[j]))
            if x != y:
                top[x] = y
                out.append((int(nids[u]), int(nids[j])))
    return out


def block_links(open_: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes within keys of three or more members (of two, the star rounds saw the only pair).

    A key's members are dealt to blocks of bounded count and bytes; every two blocks meet in one task, so a
    member is sent once per block of its key and a hot key is many tasks.
    """
    weight = lists.select("nid", F.length("cells").alias("bytes"))
    rows = open_.select("key", "nid", "root").join(weight, "nid")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), need.alias("blocks")).filter("n > 2")
    dealt = rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    sent = dealt.select(task.alias("task"), "nid", "root", "own").join(lists, "nid")
    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(tasks, "task").sortWithinPartitions("task").select("task", "nid", "root", "own", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            unique = {n: (r, o, c) for n, r, o, c in rows}
            roots, blocks, cells = zip(*unique.values()) if unique else ((), (), ())
            if len(set(roots)) < 2:
                return []
            return spanning_links(np.array(list(unique)), np.array(roots), [np.frombuffer(c, np.uint64) for c in cells], np.array(blocks), threshold)

        now, rows = None, []
        for batch in batches:
            found = []
            for task, nid, root, own, cells in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if task != now:
                    found += links(rows)
                    now, rows = task, []
                rows.append((nid, root, own, cells))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = links(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, is_representative, n_shingles and n_copies (rows of equal text) of every row.

    A class is a connected component of links between texts of at least ``threshold`` similarity; equal texts are always
    one class. class_id is the least doc_id in it. Equal texts are collapsed first, so a group of copies costs one
    signature. Texts that share a band key are checked against one leader per key, in rounds with new leaders
    among keys that still hold several classes. What is left is compared exactly in blocks, so no candidate is
    lost; a pair of blocks gives back links that span its classes, never its pairs. Null, empty and wordless
    texts link only to equal texts (null is empty). Null ids count as larger than all; a class
    of null ids only has a null class_id. Repeated rows share a class and are all marked if they represent it. Other
    columns are not read; an empty table gives an empty result.
    """
    rows = durable(signed(df, text, doc_id), "signed")
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    nodes = durable(nodes.withColumn("nid", F.monotonically_increasing_id()), "texts")
    keyed = nodes.select("nid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    bands = durable(keyed.join(shared, "key"), "bands")

    wanted = nodes.join(bands.select("nid").distinct(), "nid").select("nid", "k1", "k2", F.col("rep").alias("doc_id"))
    texts = df.select(
        F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__k1"), F.xxhash64(F.lit(7), F.coalesce(text, F.lit(""))).alias("__k2"), F.col(text).alias("__text")
    )
    same = (F.col("__id").eqNullSafe(F.col("doc_id"))) & (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))
    lists = durable(shingle_lists(texts.join(wanted, same), ["nid"]).groupBy("nid").agg(F.first("cells").alias("cells")), "cells")

    spark = df.sparkSession
    roots = spark.createDataFrame([], "node long, root long")
    links = tested = spark.createDataFrame([], "a long, b long")
    open_ = bands.withColumn("root", F.col("nid"))
    for turn in range(ROUNDS + 1):
        if turn:
            placed = bands.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
            many = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
            open_ = durable(placed.join(many, "key"), "open")
            if not open_.limit(1).count():
                break
        if turn < ROUNDS:
            salt = F.lit((turn * 0x5851F42D4C957F2D) & 0x7FFFFFFFFFFFFFFF)
            # xor with a constant is its own inverse: the least salted node names the leader
            lead = open_.groupBy("key").agg(F.min(F.col("nid").bitwiseXOR(salt)).bitwiseXOR(salt).alias("lead"))
            lead = lead.join(open_.select("key", F.col("nid").alias("lead"), F.col("root").alias("lead_root")), ["key", "lead"])
            pairs = open_.join(lead, "key").filter("root <> lead_root").select(F.least("nid", "lead").alias("a"), F.greatest("nid", "lead").alias("b"))
        else:
            links = links.union(durable(block_links(open_, lists, threshold), "links"))
            roots = components(links)
            break
        pairs = durable(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        found = durable(similar(pairs, lists, threshold), "links")
        links = links.union(found.select("a", "b"))
        if found.limit(1).count():
            roots = components(links)
    classes = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    classes = durable(classes.select("k1", "k2", "nid", "rep", "root", "n_copies"), "classes")
    best = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.when(F.col("rep").isNull(), F.col("nid"))).alias("null_nid"))
    marked = classes.join(best, "root").select(
        "k1",
        "k2",
        "class_id",
        "n_copies",
        F.when(F.col("class_id").isNull(), F.col("nid") == F.col("null_nid")).otherwise(F.coalesce(F.col("rep") == F.col("class_id"), F.lit(False))).alias("leads"),
    )
    return rows.select("doc_id", "k1", "k2", "n_shingles").join(marked, ["k1", "k2"]).select(
        "doc_id",
        "class_id",
        (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_representative"),
        "n_shingles",
        "n_copies",
        "k1",
        "k2",
    )
