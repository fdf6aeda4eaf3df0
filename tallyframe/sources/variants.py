"""Helpers for JSON held as variant: presence, kind and full-depth walks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.plans.durable import durable


def field(v: Column, *names: str) -> Column:
    """Variant at a key path; SQL NULL only when a key is absent (JSON null stays a variant)."""
    path = "$" + "".join(f"[{_quoted(n)}]" for n in names)
    return F.try_variant_get(v, path, "variant")


def _quoted(name: str) -> str:
    if '"' in name:
        raise ValueError(f"unsupported key {name!r}")
    return f'"{name}"'


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


#: Levels that one round opens; what is still open after it is written and opened further.
LEVELS = 4


def leaves(df: DataFrame, col: str, into_arrays: bool = True) -> DataFrame:
    """One row per leaf value of a variant column, at any depth: adds ``path`` (keys) and ``leaf``.

    A round opens ``LEVELS`` levels in one pass, in which finished leaves ride along, and its rows are written; only values
    that are still open enter the next round, so shallow rows are opened once. A job runs per round when this is called.
    """
    kept = [c for c in df.columns if c != col]

    def container(v: Column) -> Column:
        return (is_object(v) | is_array(v)) if into_arrays else is_object(v)

    level = df.select(*kept, F.array().cast("array<string>").alias("path"), F.col(col).alias("leaf")).withColumn("__open", container(F.col("leaf")))
    done: list[DataFrame] = []
    while True:
        for _ in range(LEVELS):
            level = _opened(level, kept).withColumn("__open", container(F.col("leaf")))
        written = durable(level, "leaves")
        done.append(written.filter(~F.col("__open")).drop("__open"))
        level = written.filter("__open")
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def _opened(level: DataFrame, kept: list[str]) -> DataFrame:
    inner = level.sparkSession.tvf.variant_explode_outer(F.when(F.col("__open").outer(), F.col("leaf").outer()))
    step = F.concat("path", F.array(F.coalesce("__key", F.col("__pos").cast("string"))))
    return (
        level.lateralJoin(inner.toDF("__pos", "__key", "__value"))
        .filter(~F.col("__open") | F.col("__pos").isNotNull())  # empty containers hold no leaf
        .select(*kept, F.when(F.col("__open"), step).otherwise(F.col("path")).alias("path"), F.when(F.col("__open"), F.col("__value")).otherwise(F.col("leaf")).alias("leaf"))
    )
