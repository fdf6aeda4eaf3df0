"""Result sink and multi-run result scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RESULT_SCHEMA = (
    "example_idx bigint, seq bigint, score double, feedback string, latency double, cost double, "
    "tokens struct<input:bigint,output:bigint>, error string, prediction string"
)


def to_record(df: DataFrame) -> DataFrame:
    """Flat result rows to the nested record that is written to disk."""
    return df.withColumn("tokens", F.struct(F.col("tokens_in").alias("input"), F.col("tokens_out").alias("output"))).drop(
        "tokens_in", "tokens_out"
    )


def from_record(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != "tokens"],
        F.col("tokens.input").alias("tokens_in"),
        F.col("tokens.output").alias("tokens_out"),
    ).drop("tokens")


def write_results(df: DataFrame, path: str, fmt: str = "json", by: str | None = "run_id") -> None:
    """Append one record per example, one directory per run.

    Rebalancing gathers small runs into few files and lets adaptive execution split a hot run
    over several tasks, so neither tiny files nor one giant writer result.
    """
    rows = to_record(df)
    writer = (rows.hint("rebalance", by) if by else rows).write.mode("append")
    if by:
        writer = writer.partitionBy(by)
    writer.format(fmt).option("ignoreNullFields", "false").save(path)


_RUN_PATH = r"/([^/]+)/([^/]+)/results/(\d{4})/evals/(\d{4})/results\.jsonl(?:/|\z)"


_SCHEME = r"^\w+:(?://[^/]*)?"


def _plain(path: Column) -> Column:
    """Scanned paths are percent-encoded, names are not; a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All ``<root>/<program>/<version>/results/<NNNN>/evals/<MMMM>/results.jsonl`` in one scan.

    Program, version and both numbers come from the path; the glob leaves other names
    unlisted, so they cost nothing.
    """
    four = "[0-9]" * 4
    return _with_path(spark.read.schema(RESULT_SCHEMA).json(f"{root.rstrip('/')}/*/*/results/{four}/evals/{four}/results.jsonl"))


def _with_path(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return from_record(
        df.select(
            _plain(F.regexp_extract(path, _RUN_PATH, 1)).alias("program"),
            _plain(F.regexp_extract(path, _RUN_PATH, 2)).alias("version"),
            F.regexp_extract(path, _RUN_PATH, 3).cast("bigint").alias("run_number"),
            F.regexp_extract(path, _RUN_PATH, 4).cast("bigint").alias("eval_number"),
            *df.columns,
        )
    )


def follow_runs(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """``read_runs`` as a stream: the query's checkpoint remembers the files it has read, so a run added later is read
    once and the others not again. Start it with ``sinks.append_sink``, without ``every`` to take in what is there and end.

    The folders below ``root`` are walked (by tasks where there are many side by side), no pattern is expanded on the
    driver; rows of files elsewhere than ``<program>/<version>/results/<NNNN>/evals/<MMMM>/results.jsonl`` are left out.
    A file must appear whole and never change: what is appended to a file that was read is not seen.
    """
    reader = spark.readStream.schema(RESULT_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path, place = F.col("_metadata.file_path"), re.sub(_SCHEME, "", root.rstrip("/"))
    above = _plain(F.regexp_replace(path, f"{_SCHEME}|{_RUN_PATH}.*", ""))
    inside = above == place if place.startswith("/") else above.endswith(f"/{place}")
    return _with_path(reader.json(root).filter(path.rlike(_RUN_PATH) & inside))
