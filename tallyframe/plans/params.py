"""Driver-held parameter tables (prices, grids, rules): broadcast while they are short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_PARAM_ROWS = 10_000


def param_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter list as a relation: broadcast up to MAX_PARAM_ROWS rows, beyond that joined as its size says."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= MAX_PARAM_ROWS else table
