"""JSON-lines scans: example files with a global row index, and tolerant result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from tallyframe.sources.variants import field, is_object


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))


def read_examples(spark: SparkSession, path: str | list[str], per_file: bool = False) -> DataFrame:
    """``(row_idx, value, record)``: non-blank lines numbered from 0 in file order.

    Two passes, no sort of the data: the first counts lines per file split, the second adds
    each split's offset to the position inside the split. Malformed JSON raises.
    """
    lines = _lines(spark, path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
    ).withColumn("__at", F.monotonically_increasing_id())
    # One row per file split, so the ordered window below is tiny whatever the data size.
    splits = lines.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    w = (W.partitionBy("__file").orderBy("__start") if per_file else W.orderBy("__file", "__start"))
    offsets = splits.withColumn("__before", F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = lines.join(offsets, ["__file", "__start"])
    cols = [
        (F.col("__before") + F.col("__at") - F.col("__first")).alias("row_idx"),
        "value",
        F.parse_json("value").alias("record"),
    ]
    if per_file:
        cols.insert(0, F.col("__file").alias("file"))
    return out.select(*cols)


def _number(record, name):
    """Numeric reading of a key: numbers and booleans count, strings do not."""
    v = field(record, name)
    kind = F.schema_of_variant(v)
    numeric = F.regexp_like(kind, F.lit(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(
        numeric, F.try_variant_get(v, "$", "double")
    )


def read_results(spark: SparkSession, path: str | list[str], tolerant: bool = True) -> DataFrame:
    """Result rows from JSON lines.

    Tolerant: blank, malformed and non-object lines and rows without a numeric ``score``
    are skipped (a boolean counts as numeric). Strict: malformed lines raise.
    """
    parse = F.try_parse_json if tolerant else F.parse_json
    rec = F.col("record")
    rows = _lines(spark, path).select(parse(F.col("value")).alias("record"))
    if tolerant:
        rows = rows.filter(is_object(rec))
    out = rows.select(
        F.try_variant_get(rec, "$.run_id", "string").alias("run_id"),
        F.try_variant_get(rec, "$.example_idx", "bigint").alias("example_idx"),
        F.try_variant_get(rec, "$.seq", "bigint").alias("seq"),
        _number(rec, "score").alias("score"),
        F.try_variant_get(rec, "$.feedback", "string").alias("feedback"),
        F.try_variant_get(rec, "$.latency", "double").alias("latency"),
        F.try_variant_get(rec, "$.cost", "double").alias("cost"),
        F.try_variant_get(rec, "$.tokens.input", "bigint").alias("tokens_in"),
        F.try_variant_get(rec, "$.tokens.output", "bigint").alias("tokens_out"),
        F.try_variant_get(rec, "$.error", "string").alias("error"),
        F.try_variant_get(rec, "$.prediction", "string").alias("prediction"),
    )
    return out.filter(F.col("score").isNotNull()) if tolerant else out
