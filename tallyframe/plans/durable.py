"""Shared-folder scratch space and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

_CONF = "spark.checkpoint.dir"
_OWN: list[tempfile.TemporaryDirectory] = []  # of local sessions without the setting; removed when Python ends


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder every executor can reach")
    _OWN.append(tempfile.TemporaryDirectory(prefix="tallyframe-", ignore_cleanup_errors=True))
    spark.sparkContext.setCheckpointDir(_OWN[-1].name)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: the same rows on every use, with no lineage.

    A written table is computed once, keeps column pruning, and has a known size. As a join side that
    size decides: small enough it is broadcast, otherwise both sides are shuffled and adaptive
    execution can split a hot key. (An aggregate would hand its partitioning to the join, and
    the other side's hot key could not be split then.) Types Parquet lacks are checkpointed instead.
    """
    if any(_unwritable(f.dataType) for f in df.schema.fields):
        shared_dir(df.sparkSession)
        return df.checkpoint()
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unwritable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_unwritable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _unwritable(t.elementType)
    if isinstance(t, T.MapType):
        return _unwritable(t.keyType) or _unwritable(t.valueType)
    return isinstance(t, (T.NullType, T.CalendarIntervalType))
