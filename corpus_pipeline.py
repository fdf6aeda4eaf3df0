"""From raw documents to packed sequences: reject, deduplicate, cut repeats, decontaminate, pack.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents, the
last one the pieces of packed sequences. Rows are told apart by id and text digests, so null and repeated ids
do no harm; an empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.llm import decontam, fmindex, importance, neardup, packing
from tallyframe.llm.columns import row_key
from tallyframe.plans.durable import durable

TOKENIZER = "byte_bpe_50k.json"
#: The classifier and the rest cannot be said in SQL.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    a, b = row_key("doc_id", "text")
    return docs.withColumns({"__d": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__a": a, "__b": b})


_KEYS = ["__d", "__null", "__a", "__b"]


def _id_keys() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("__d"), F.col("doc_id").isNull().alias("__null")]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance weight does not put them among the sampled go."""
    keyed = _keyed(docs)
    judged = importance.resample(keyed, _labels(spark, sf_dir, "labels"), keep=["__a", "__b"])
    out = judged.filter(~F.col("selected")).select(*_id_keys(), "__a", "__b").distinct()
    # Sorted and merged whatever the sizes: the rejected grow with the corpus.
    return keyed.join(durable(out, "rejected").hint("merge"), _KEYS, "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id."""
    found = neardup.near_duplicates(docs).filter("is_representative")
    stay = durable(found.select(*_id_keys(), F.col("k1").alias("__a"), F.col("k2").alias("__b")).distinct(), "kept")
    t = F.coalesce("text", F.lit(""))
    keyed = _keyed(docs).withColumns({"__a": F.xxhash64(t), "__b": F.xxhash64(F.lit(7), t)})
    # Repeated rows are one document; the aggregate's partitioning serves the join as well.
    return keyed.dropDuplicates(_KEYS).join(stay, _KEYS, "left_semi").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out; a null text comes back empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = fmindex.remove_repeated_passages(docs, keep=others, with_text=True)
    columns = [F.col("cut_text").alias("text") if c == "text" else F.char_length("cut_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontam.decontaminate(docs, _labels(spark, sf_dir, "benchmark")).filter("contaminated")
    out = durable(found.select(*_id_keys(), F.col("rk").alias("__a")).distinct(), "contaminated")
    return _keyed(docs).join(out.hint("merge"), ["__d", "__null", "__a"], "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, neighbours on the Hilbert curve together."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
