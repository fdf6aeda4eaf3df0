"""Text scored by a byte model that mixes all context lengths: context-tree weighting over binary decisions.

Method: a byte is eight binary decisions, each with a tree of contexts (the bytes before it, nearest first). A node counts
the zeros and ones seen in training; its Krichevsky-Trofimov estimate is mixed half and half with the product of
its children's mixtures, from the deepest contexts to the root, which gives each node its weight. A decision's
probability then follows its context from the root down: weight times estimate plus the rest times the child's.

1. Rows are dealt to slots of bounded size. A slot says which byte sequences (context and byte) it holds and how often
   in training rows, each once.
2. Sequences are counted, and dealt by their ``TOP`` nearest context bytes to buckets that hold whole subtrees. A subtree is
   at most 256**(DEPTH - TOP + 1) sequences, the levels above at most 256 nodes a parent.
3. Weights go from the deepest nodes up, bucket by bucket and then level by level; mixtures of the upper levels come down.
4. Buckets give every sequence its log probability, which goes back to the slots that hold it, where texts are summed.

Training is frozen: no score changes the model. Word counts for the base score travel the same way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.repeats import store
from tallyframe.plans.durable import durable, scratch

#: Bytes of context, and how many of them (the nearest) choose a bucket.
DEPTH, TOP = 5, 3
#: Bytes of text of a slot (the larger, the fewer sequences are sent), and worked on at once; byte sequences of a bucket.
SLOT_BYTES, STEP_BYTES, BUCKET_ROWS = 16 << 20, 1 << 20, 1 << 19
#: Rows whose id has this checksum remainder are held out.
FOLDS, HELD_OUT = 5, 1
#: Every word is followed by a blank and the text by this byte, which no word holds.
END = b"\n"

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SAID = "slot int, key long, word binary, n long"
_NODES = "ctx long, prefix int, a0 long, a1 long, lw double"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """A row without id is a training row."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in lists of about ``STEP_BYTES``."""
    at = 0
    while at < len(raw):
        end = at + STEP_BYTES
        if end < len(raw):  # a piece ends at a blank: the first one after a megabyte
            cut = [p for p in (raw.find(s, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            end = min(cut, default=len(raw))
        words = raw[at:end].translate(_LOWER).split()
        at = end
        if words:
            yield words


def coded(raw: bytes) -> Iterator[bytes]:
    """The byte string that is scored, in pieces: words each followed by a blank, then the end."""
    for words in words_of(raw):
        yield b" ".join(words) + b" "
    yield END


def steps(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte sequences, text number) of all positions, about ``STEP_BYTES`` at a time; before a text there are zeros."""
    parts, rows, size = [], [], 0
    for number, raw in enumerate(texts):
        before = bytes(DEPTH)
        for piece in coded(raw):
            for at in range(0, len(piece), STEP_BYTES):
                cut = piece[at : at + STEP_BYTES]
                parts.append(before + cut)
                rows.append((number, len(cut)))
                before, size = (before + cut)[-DEPTH:], size + len(cut)
                if size >= STEP_BYTES:
                    yield sequences(parts, rows)
                    parts, rows, size = [], [], 0
    if parts:
        yield sequences(parts, rows)


def sequences(parts: list[bytes], rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of each position in one number: the nearest context byte highest, the byte itself lowest."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    key = data.copy()
    for back in range(1, DEPTH + 1):
        key[DEPTH:] |= data[DEPTH - back : len(data) - back] << np.int64(8 * (DEPTH + 1 - back))
    number, size = (np.array(x) for x in zip(*rows))
    keep = np.ones(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(size + DEPTH)[:-1]])
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[keep], np.repeat(number, size)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its sum."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def held(texts: list[bytes], trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences of the texts, each with its occurrences in training texts."""
    keys, counts = [], []
    for key, row in steps(texts):
        both = np.sort(key << 1 | trained[row])
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n = np.diff(np.append(first, len(both)))
        both = both[first]
        k, c = summed(both >> 1, n * (both & 1))
        keys.append(k)
        counts.append(c)
        if len(keys) > 8:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [c]
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_counts(texts: list[bytes], trained: np.ndarray) -> dict[bytes, int]:
    """The texts' words, and the empty word for their ends, with their occurrences in training texts."""
    words: dict[bytes, int] = {b"": int(trained.sum())}
    for raw, n in zip(texts, trained.tolist()):
        for some in words_of(raw):
            for w in some:
                words[w] = words.get(w, 0) + n
    return words


def slot_rows(t: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """(rows, texts, training or not) of a slot, always in one order, so its words are numbered alike each time."""
    t = t.sort_by("rid")
    return t, [x.encode() for x in t.column("text").to_pylist()], np.array([not held_out(i) for i in t.column("doc_id").to_pylist()], np.int64)


def said(stored: DataFrame) -> DataFrame:
    """(slot, key, word, n): distinct byte sequences and words of every slot and their occurrences in training rows.

    Words (the empty one is the end of a text) come with keys -1, -2, .. in the slot's own order, sequences have no word.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(_SAID))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, texts, trained = slot_rows(t)
        keys, counts = held(texts, trained)
        words = word_counts(texts, trained)
        n = len(keys) + len(words)
        return pa.table(
            [pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.append(keys, -1 - np.arange(len(words)))),
             pa.array([None] * len(keys) + list(words), pa.binary()), pa.array(np.append(counts, np.array(list(words.values()), np.int64)))], schema=arrow)

    return stored.select("slot", "rid", "doc_id", "text").groupBy("slot").applyInArrow(run, _SAID)


_LN2 = math.log(2)
_TABLE = 1 << 12
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])  # ln of n!
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])  # ln of the product of the first n odd halves


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large arguments."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def estimate(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of a0 zeros and a1 ones."""

    def half(n):
        return np.where(n < _TABLE, _HALF[np.minimum(n, _TABLE - 1)], _log_gamma(np.maximum(n, _TABLE) + 0.5) - 0.5 * math.log(math.pi))

    n = a0 + a1
    return half(a0) + half(a1) - np.where(n < _TABLE, _FACT[np.minimum(n, _TABLE - 1)], _log_gamma(np.maximum(n, _TABLE) + 1.0))


def mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the mixture, weight of the node's own estimate) from ln of both probabilities."""
    both = np.logaddexp(own, children) - _LN2
    return both, np.exp(own - _LN2 - both)


class Levels:
    """The nodes of some subtrees, from the deepest contexts up to those of ``TOP`` bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` sorted and distinct."""
        self.keys, self.up, self.nodes = keys, [], []
        for depth in range(DEPTH, TOP - 1, -1):
            level = [self._nodes(keys, counts, bit) for bit in range(8)]
            if depth < DEPTH:
                for bit, (node, below) in enumerate(zip(level, self.nodes[-1])):
                    parent = node["of"][self.up[-1][below["first"]]]
                    node["lw"], node["weight"] = mixed(node["lw"], np.bincount(parent, below["lw"], len(node["first"])))
            self.nodes.append(level)
            if depth > TOP:  # drop the farthest context byte
                upper = (keys >> 16 << 8) | (keys & 255)
                keys, inverse = np.unique(upper, return_inverse=True)
                counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
                self.up.append(inverse)

    @staticmethod
    def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> dict:
        """Nodes of one decision: ``of`` maps sequences to them, ``first`` back to one sequence each."""
        name = keys >> (8 - bit)
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(keys) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        one = (keys >> (7 - bit) & 1).astype(bool)
        a1 = np.bincount(of, counts * one, len(first)).astype(np.int64)
        a0 = np.bincount(of, counts * ~one, len(first)).astype(np.int64)
        return {"of": of, "first": first, "a0": a0, "a1": a1, "lw": estimate(a0, a1), "keys": keys}

    def top(self) -> list[np.ndarray]:
        """Columns of the ``TOP`` level's nodes: context, decision, zeros, ones, ln of the mixture."""
        out = []
        for bit, n in enumerate(self.nodes[-1]):
            key = n["keys"][n["first"]]
            out.append((key >> 8, (1 << bit) | ((key & 255) >> (8 - bit)), n["a0"], n["a1"], n["lw"]))
        return [np.concatenate(c) for c in zip(*out)]

    def log10(self, ctx: np.ndarray, prefix: np.ndarray, above: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of every sequence's byte; the upper levels' mixtures as (context, decision, above, rest)."""
        name = ctx << 8 | prefix
        order = np.argsort(name)
        name, above, rest = name[order], above[order], rest[order]
        total = np.zeros(len(self.keys))
        for bit in range(8):
            which, p = np.arange(len(self.keys)), None
            for level, nodes in enumerate(self.nodes):
                n = nodes[bit]
                if level:
                    which = self.up[level - 1][which]
                of = n["of"][which]
                own = (n["a1"] + 0.5) / (n["a0"] + n["a1"] + 1)
                p = own[of] if p is None else n["weight"][of] * own[of] + (1 - n["weight"][of]) * p
            top = self.nodes[-1][bit]["keys"]
            at = np.searchsorted(name, (top >> 8 << 8) | ((1 << bit) | ((top & 255) >> (8 - bit))))[which]
            p = above[at] + rest[at] * p
            one = (self.keys >> (7 - bit) & 1).astype(bool)
            total += np.log10(np.where(one, p, 1 - p))
        return total


def _numpy(t: pa.Table, *columns: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in columns]


def bottom(grams: DataFrame) -> DataFrame:
    """The ``TOP`` level's nodes of all buckets; grams has (bucket, key, n)."""
    arrow = to_arrow_schema(T._parse_datatype_string(_NODES))

    def run(t: pa.Table) -> pa.Table:
        keys, n = _numpy(t, "key", "n")
        order = np.argsort(keys)
        return pa.table([pa.array(c).cast(f) for c, f in zip(Levels(keys[order], n[order]).top(), arrow.types)], schema=arrow)

    return grams.groupBy("bucket").applyInArrow(run, _NODES)


def upper(nodes: DataFrame) -> DataFrame:
    """One level up: contexts one byte shorter, with the weight of their own estimates. A parent has at most 256 children."""
    sums = nodes.groupBy((F.shiftright("ctx", 8)).alias("ctx"), "prefix").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"), F.sum("lw").alias("children"))
    schema = f"{_NODES}, weight double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a0, a1, children = (b.column(c).to_numpy() for c in ("a0", "a1", "children"))
            lw, weight = mixed(estimate(a0, a1), children)
            yield pa.RecordBatch.from_arrays([b.column("ctx"), b.column("prefix"), b.column("a0"), b.column("a1"), pa.array(lw), pa.array(weight)], schema=arrow)

    return sums.mapInArrow(run, schema)


def mixtures(top: DataFrame) -> DataFrame:
    """(ctx, prefix, above, rest) for the ``TOP`` level's nodes: p(one) = above + rest * what the node itself says."""
    levels = [top]
    for _ in range(TOP):
        levels.append(durable(upper(levels[-1]), "level"))
    own = F.col("weight") * (F.col("a1") + 0.5) / (F.col("a0") + F.col("a1") + 1)
    down = levels[-1].select("ctx", "prefix", own.alias("above"), (1 - F.col("weight")).alias("rest"))
    for level in levels[-2::-1]:
        parent = durable(down, "mixture").withColumnRenamed("ctx", "parent")
        down = level.withColumn("parent", F.shiftright("ctx", 8)).join(parent, ["parent", "prefix"])
        if level is top:
            return down.select("ctx", "prefix", "above", "rest")
        down = down.select("ctx", "prefix", (F.col("above") + F.col("rest") * own).alias("above"), (F.col("rest") * (1 - F.col("weight"))).alias("rest"))


def bucket_of(ctx: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ctx), F.lit(buckets)).cast("int").alias("bucket")


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(key, lp): log10 probability of every sequence's byte after its context; grams has (key, n), stored."""
    buckets = max(1, -(-grams.count() // BUCKET_ROWS), int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = grams.withColumn("bucket", bucket_of(F.shiftright("key", 8 * (DEPTH + 1 - TOP)), buckets))
    mixture = mixtures(durable(bottom(dealt), "nodes")).withColumn("bucket", bucket_of(F.col("ctx"), buckets))
    arrow = to_arrow_schema(T._parse_datatype_string("key long, lp double"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n = _numpy(left, "key", "n")
        order = np.argsort(keys)
        keys = keys[order]
        lp = Levels(keys, n[order]).log10(*[x.astype(t) for x, t in zip(_numpy(right, "ctx", "prefix", "above", "rest"), (np.int64, np.int64, float, float))])
        return pa.table([pa.array(keys), pa.array(lp)], schema=arrow)

    return dealt.groupBy("bucket").cogroup(mixture.groupBy("bucket")).applyInArrow(run, "key long, lp double")


def packed(df: DataFrame, label: str) -> DataFrame:
    """Written once and read back like ``durable``, but pressed harder: sorted sequences take half the room."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from the rows that are not held out (by the checksum of their id; a null id is a training row). The
    base score adds up half-count estimates of words and one end; ``score`` is the tree model's log10 probability of the same
    lower-cased words, each followed by a blank, and the end, so both speak of the same tokens. Bits per byte are
    -log2(10) * score over the coded bytes. A null text is empty: one end. Repeated rows count and are scored each;
    with no training rows every decision is one half; an empty table gives an empty one; other columns are not read.
    """
    stored, _ = store(df, text, doc_id, slot_bytes=SLOT_BYTES)
    spoken = packed(said(stored), "said")
    grams = packed(spoken.filter("key >= 0").groupBy("key").agg(F.sum("n").alias("n")), "sequences")
    words = durable(spoken.filter("key < 0").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train, below = int(total.n or 0), float((total.n or 0) + 0.5 * (total.v + 1))
    learned = packed(log_probabilities(grams), "learned")
    of_keys = spoken.filter("key >= 0").select("slot", "key").join(learned, "key").select("slot", "key", F.col("lp").alias("value"))
    # A slot that holds all of a word's training occurrences has counted them itself.
    shared = spoken.filter("key < 0").select("slot", "key", "word", F.col("n").alias("own")).join(words, "word").filter("n > own")
    told = of_keys.unionByName(shared.select("slot", "key", F.col("n").cast("double").alias("value")))
    arrow = to_arrow_schema(T._parse_datatype_string(_SCORED))
    unseen = float(np.log10(0.5 / below))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs, texts, trained = slot_rows(docs)
        keys, values = _numpy(told, "key", "value")
        del told
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        words = word_counts(texts, trained)
        counts = np.array(list(words.values()), float)
        n_words = int(np.searchsorted(keys, 0))
        counts[-1 - keys[:n_words]] = values[:n_words]
        logs = dict(zip(words, np.log10((counts + 0.5) / below).tolist()))
        del words, counts
        keys, lp = keys[n_words:], values[n_words:]
        scores = np.zeros(len(texts))
        for key, row in steps(texts):
            order = np.argsort(key)  # looked up in order, which is faster
            scores += np.bincount(row[order], lp[np.searchsorted(keys, key[order])], len(texts))
        tokens, seen, base = [], [], []
        for raw in texts:
            each = [list(map(logs.__getitem__, some)) for some in words_of(raw)] + [[logs[b""]]]
            tokens.append(sum(map(len, each)))
            seen.append(tokens[-1] - sum(x.count(unseen) for x in each))
            base.append(math.fsum(map(math.fsum, each)))
        columns = [docs.column("doc_id"), pa.array(trained == 0), tokens, seen, np.full(len(texts), n_train), base, scores]
        return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return stored.select("slot", "rid", "doc_id", "text").groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(run, _SCORED)
