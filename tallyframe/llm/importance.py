"""Importance resampling of raw text toward labelled target text.

Method: two generative models over hashed word n-grams, one of target text and one of all raw
text. A document's log weight is the mean of the log ratios of its n-grams (so length does not decide). A second
pair of models, of toxic and clean labelled documents, gives a toxic weight: the sum over the document's different
n-grams of what their log ratios exceed a limit by, so a few telling words count however long the text is. Documents are
sampled without replacement by Gumbel top-k on the lesser of their margins over the two cutoffs / temperature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.llm.columns import kept_fields, text_steps, with_text
from tallyframe.llm.words import WORD_BASE, mix, word_hashes, word_spans
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import row_numbers

#: Buckets of the models: both are arrays of this fixed size whatever the corpus.
BUCKET_BITS = 20
#: Labelled rows used, those with the smallest id hashes; of each five, four fit the model and one is held out.
LABEL_ROWS = 60_000
#: Added to both counts of a bucket, so that rare n-grams weigh little.
PRIOR = 10.0
#: Log ratios nearer to 0 than this are noise of the counts and taken as 0.
LEAST_RATIO = 0.5
#: Log ratios of toxic over clean count by what they exceed this.
TOXIC_RATIO = 1.0
#: Margins are divided by this before Gumbel noise is added: near 0 the sample is the k heaviest.
TEMPERATURE = 2e-4
#: A clean held-out document lost counts as so many bad ones kept, when the sample size is chosen.
CLEAN_COST = 50.0
_BLOCK = 1 << 12
#: Letters (lower-cased where ASCII), digits and all bytes beyond ASCII stay; other bytes become blanks.
_PLAIN = np.frombuffer(bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256)), np.uint8)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the document each belongs to.

    The n-grams are words as written, pairs of them, and lower-cased runs of letters and digits.
    """
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    pairs = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    two = mix(words[pairs] * np.uint64(WORD_BASE) + words[pairs + 1])
    plain = _PLAIN[data]
    starts, ends, firsts = word_spans(plain, offsets)
    bare = mix(word_hashes(plain, starts, ends) + np.uint64(9))
    bare_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    shift = np.uint64(64 - BUCKET_BITS)
    return (np.concatenate([words, two, bare]) >> shift).astype(np.int64), np.concatenate([doc, doc[pairs], bare_doc])


_COUNTS_SCHEMA = "block int, first binary, second binary"


def _blocks(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    # One task's counts fit 32 bits; the sums over tasks take 64.
    blocks = range(0, len(first), _BLOCK)
    pack = lambda a: pa.array([a[b : b + _BLOCK].astype("<u4").tobytes() for b in blocks], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([b // _BLOCK for b in blocks], pa.int32()), pack(first), pack(second)], ["block", "first", "second"])


def _summed(parts: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the blocks that tasks send; a second step adds them up as they stream in."""
    n = 1 << BUCKET_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                both = np.stack([np.frombuffer(row["first"], "<u4"), np.frombuffer(row["second"], "<u4")]).astype(np.int64)
                sums[row["block"]] = sums[row["block"]] + both if row["block"] in sums else both
        if sums:
            keys = list(sums)
            cols = [pa.array([sums[b][i].tobytes() for b in keys], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *cols], ["block", "first", "second"])

    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for row in parts.repartition(tasks, "block").mapInArrow(add, _COUNTS_SCHEMA).toLocalIterator():
        at = slice(row["block"] * _BLOCK, (row["block"] + 1) * _BLOCK)
        first[at] += np.frombuffer(row["first"], "<i8")
        second[at] += np.frombuffer(row["second"], "<i8")
    return first, second


def bucket_counts(df: DataFrame, targets: np.ndarray, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over all raw text and over the target documents.

    Tasks count into fixed arrays and send blocks of them.
    """
    n = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_steps(batch.column(1)):
                buckets, doc = gram_buckets(data, offsets)
                raw += np.bincount(buckets, minlength=n)
                target += np.bincount(buckets[np.isin(ids[first:end], targets)[doc]], minlength=n)
        if raw.any():
            yield _blocks(raw, target)

    return _summed(with_text(df, text, [doc_id]).mapInArrow(count, _COUNTS_SCHEMA), n // _BLOCK)


def document_counts(df: DataFrame, kinds: DataFrame, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """Clean and toxic documents per bucket, of ``kinds`` (doc_id, toxic; at most LABEL_ROWS).

    One text stands for an id, the one with the least digest, so a repeated id weighs as any other; partial
    aggregates keep one row per id and task.
    """
    n = 1 << BUCKET_BITS
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.struct(F.xxhash64(t).alias("h"), t.alias("t")).alias("__t")).join(F.broadcast(kinds), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("__t").alias("__t")).select("toxic", F.col("__t.t").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n), np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_steps(batch.column(1)):
                buckets, doc = gram_buckets(data, offsets)
                seen = np.unique((doc.astype(np.int64) << BUCKET_BITS) | buckets)
                own = toxic[first:end][seen >> BUCKET_BITS]
                for i in (0, 1):
                    sums[i] += np.bincount(seen[own == bool(i)] & (n - 1), minlength=n)
        if sums.any():
            yield _blocks(*sums)

    # Few tasks, since each sends whole arrays.
    return _summed(with_text(rows, "text", ["toxic"]).coalesce(16).mapInArrow(count, _COUNTS_SCHEMA), 8)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, drawn to 0 where a bucket has few counts."""
    share = raw.sum() / max(target.sum(), 1)
    ratio = np.log((target * share + PRIOR) / (raw + PRIOR))
    return np.where(np.abs(ratio) < LEAST_RATIO, 0, ratio).astype(np.float32)


def toxic_excess(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """What the log of toxic over clean document share exceeds TOXIC_RATIO by, per bucket; 0 where it does not."""
    ratio = np.log((toxic * (n_clean / max(n_toxic, 1)) + PRIOR) / (clean + PRIOR))
    return np.maximum(ratio - TOXIC_RATIO, 0).astype(np.float32)


def weigh(df: DataFrame, ratios: np.ndarray, excess: np.ndarray, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, n_grams, log_weight and toxic_weight of every whole text; no shuffle. No words: weights 0."""
    keep = list(keep)
    added = [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("toxic_weight", T.DoubleType())]
    schema = T.StructType([*kept_fields(df, keep), *added])
    table = df.sparkSession.sparkContext.broadcast(np.stack([ratios, excess]))  # two floats per bucket, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, excess = table.value
        for batch in batches:
            n, total, toxic = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, end, data, offsets in text_steps(batch.column(len(keep))):
                buckets, doc = gram_buckets(data, offsets)
                n[first:end] = np.bincount(doc, minlength=end - first)
                total[first:end] = np.bincount(doc, weights=ratios[buckets], minlength=end - first)
                telling = np.flatnonzero(excess[buckets])
                seen = np.unique((doc[telling].astype(np.int64) << BUCKET_BITS) | buckets[telling])
                toxic[first:end] = np.bincount(seen >> BUCKET_BITS, weights=excess[seen & ((1 << BUCKET_BITS) - 1)], minlength=end - first)
            cols = [pa.array(n), pa.array(total / np.maximum(n, 1)), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], [*keep, *(f.name for f in added)])

    return with_text(df, text, keep).mapInArrow(run, schema)


def best_cutoff(weights: np.ndarray, clean: np.ndarray) -> float:
    """Log weight below which held-out documents are best left out; the middle of the widest best gap.

    -inf, so that none is left out, where no row or no bad or no clean one was held out; never above all clean ones.
    """
    if not len(weights) or clean.all() or not clean.any():
        return -np.inf
    order = np.argsort(weights)
    w, good = weights[order], clean[order]
    lost = np.concatenate([[0], np.cumsum(good)]) * CLEAN_COST + np.concatenate([[0], np.cumsum(~good)])[-1] - np.concatenate([[0], np.cumsum(~good)])
    gap = np.concatenate([[0.0], np.diff(w), [0.0]])  # cutting before i separates w[i - 1] from w[i]
    gap[1:-1] = np.where(gap[1:-1] > 0, gap[1:-1], -1)
    at = np.flatnonzero(gap[: np.flatnonzero(good)[-1] + 1] >= 0)
    i = max(at[lost[at] == lost[at].min()], key=lambda i: gap[i])
    return -np.inf if i == 0 else float((w[i - 1] + w[i]) / 2)


def resample(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = (), seed: int = 17, k: int | None = None
) -> DataFrame:
    """doc_id, ``keep``, n_grams, log_weight, toxic_weight, gumbel_key and selected (among the ``k`` largest keys) of every row.

    ``labels`` (doc_id, quality, toxic): target text is quality 1 and not toxic; an id labelled twice
    counts as its worst. One cutoff parts held-out clean rows from those of bad quality by log_weight, another from toxic ones by
    toxic_weight; the key is made of the lesser margin. Without ``k`` the sample has as many rows as pass both;
    with no labels, or none bad, every row is selected. Null and
    empty texts weigh 0; a null id is never a label; repeated rows share their noise and ties follow the
    id; an empty table gives an empty result.
    """
    spark = df.sparkSession
    known = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"), (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("harmless"))
        .select("doc_id", F.coalesce("good", F.lit(False)).alias("good"), "harmless", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
        .orderBy("h", "doc_id")
        .limit(LABEL_ROWS)
    )
    rows = known.collect()  # at most LABEL_ROWS
    fit = np.array([r["doc_id"] for r in rows if r["good"] and r["harmless"] and r["h"] % 5], dtype=np.int64)
    harmful = [r["doc_id"] for r in rows if not r["harmless"] and r["h"] % 5]
    held = [(r["doc_id"], r["good"], r["harmless"]) for r in rows if not r["h"] % 5]
    raw, target = bucket_counts(df, fit, text, doc_id)
    ratios = log_ratios(raw, target) if len(fit) and target.any() else np.zeros(len(raw), np.float32)
    excess = np.zeros(len(raw), np.float32)
    if len(fit) and harmful:
        kinds = spark.createDataFrame([(int(d), False) for d in fit] + [(d, True) for d in harmful], "doc_id long, toxic boolean")
        excess = toxic_excess(*document_counts(df, kinds, text, doc_id), len(fit), len(harmful))
    scored = durable(weigh(df, ratios, excess, text, [doc_id, *keep]).withColumnRenamed(doc_id, "doc_id"), "weights")
    answers = F.broadcast(spark.createDataFrame(held, "doc_id long, good boolean, harmless boolean"))  # at most LABEL_ROWS
    # One row per id, which counts as its worst text: as many as there are labels.
    worst = scored.join(answers, "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.max("toxic_weight").alias("toxic_weight"), F.first("good").alias("good"), F.first("harmless").alias("harmless"))
    seen = worst.collect()  # at most LABEL_ROWS
    clean = np.array([r["good"] and r["harmless"] for r in seen], bool)
    bad, toxic = (np.array([not r[c] for r in seen], bool) for c in ("good", "harmless"))
    cutoff = best_cutoff(np.array([r["log_weight"] for r in seen])[clean | bad], clean[clean | bad])
    most = best_cutoff(-np.array([r["toxic_weight"] for r in seen])[clean | toxic], clean[clean | toxic])
    # Without a cutoff the least weight is the margin's zero, so that every row passes.
    zero = cutoff if cutoff > -np.inf else scored.agg(F.min("log_weight")).first()[0] or 0.0
    margin = F.col("log_weight") - F.lit(float(zero))
    margin = F.least(margin, -F.col("toxic_weight") - F.lit(float(most))) if most > -np.inf else margin
    if k is None:
        k = scored.filter(margin >= 0).count()
    uniform = (F.xxhash64("doc_id", F.lit(seed), F.lit("gumbel")) / F.lit(2.0**64) + 0.5) * (1 - 2.0**-50) + 2.0**-51
    keyed = scored.withColumn("gumbel_key", margin / TEMPERATURE - F.log(-F.log(uniform)))
    ranked = row_numbers(keyed, [], [F.col("gumbel_key").desc(), F.col("doc_id")], "__rank")
    return ranked.withColumn("selected", F.col("__rank") <= k).drop("__rank")
