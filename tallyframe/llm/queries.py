"""Registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, decontam, fmindex, importance, licenses, neardup, oracles, packing, rules, runs, search, sharding, suffixes, trees
from tallyframe.plans.durable import durable, scratch

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.builtin_licenses(spark))


def op6_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    assigned = durable(sharding.assign(table(spark, sf_dir, "documents")), "slots")
    path = scratch(spark, "slot-map")
    sharding.store_map(sharding.first_map(spark, shards), path)
    sharding.store_map(sharding.add_shard(sharding.load_map(spark, path, 1), shards), path)
    return sharding.place(assigned, sharding.load_map(spark, path, 1), sharding.load_map(spark, path, 2))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), loop_ids="doc_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.score(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_packing,
        op3_near_duplicates,
        op4_quality_rules,
        op5_licenses,
        op6_shards,
        op7_quality_classifier,
        op8_substrings,
        op9_decontamination,
        op10_suffix_array,
        op11_periodic_runs,
        op12_ranked_search,
        op13_lm_scores,
        pipeline,
    )
}
ORACLE = dict(oracles.ORACLE)
