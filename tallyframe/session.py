"""Session defaults the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Prune "first n per key" before the shuffle for larger n as well (Spark's default stops at 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Merge a busy key's session windows before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# The settings that decide how hot keys are handled; safe to apply to any running session.
SKEW_SETTINGS = (
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
    "spark.sql.optimizer.windowGroupLimitThreshold",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition",
)


def apply_skew_settings(spark: SparkSession) -> SparkSession:
    for key in SKEW_SETTINGS:
        spark.conf.set(key, SETTINGS[key])
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
