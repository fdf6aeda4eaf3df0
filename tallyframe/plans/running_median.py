"""Exact running median per run, with every task bounded by the block size.

Rows of a run are cut by position into blocks. While a block's rows arrive, the median can move at
most half a block to either side of where it stood at the block's start, so a task needs only its own
rows, the earlier values around that point, and how many earlier values lie below them. Which
earlier values those are follows from counts per (block, value range).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import CHUNK, ROWS_PER_CHUNK, Running, int_chunk, range_chunks, running


def block_medians(earlier: np.ndarray, below: int, total: int, own: np.ndarray) -> np.ndarray:
    """Median after each of ``own``, given ``total`` earlier values.

    ``earlier`` holds the earlier values near the middle; ``below`` more lie under all of them.
    Works backwards from the full sorted list, unlinking one value per step.
    """
    values = np.concatenate([earlier, own])
    order = np.argsort(values, kind="stable")
    at = np.empty(len(values), dtype=np.int64)
    at[order] = np.arange(len(values))
    ordered = values[order]
    prev = list(range(-1, len(values) - 1))
    nxt = list(range(1, len(values) + 1))
    slots = at[len(earlier):].tolist()
    out = np.empty(len(own))
    n = total + len(own)
    cur = (n - 1) // 2 - below
    for k in range(len(own) - 1, -1, -1):
        out[k] = ordered[cur] if n % 2 else (ordered[cur] + ordered[nxt[cur]]) / 2
        if k == 0:
            break
        gone = slots[k]
        # Lower-middle rank goes from (n-1)//2 to (n-2)//2: one less exactly when n is odd.
        step_back = n % 2 == 1
        if gone == cur:
            cur = prev[cur] if step_back else nxt[cur]
        elif gone < cur:
            cur = cur if step_back else nxt[cur]
        elif step_back:
            cur = prev[cur]
        left, right = prev[gone], nxt[gone]
        if left >= 0:
            nxt[left] = right
        if right < len(values):
            prev[right] = left
        n -= 1
    return out


def running_median(
    df: DataFrame, run: str, seq: str, value: str, name: str, rows_per_block: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``(run, seq, name)``: median of all values up to and including each row; ``seq`` is unique per run."""
    spark = df.sparkSession
    placed = running(df.select(run, seq, value), [run], [F.col(seq)], int_chunk(seq, rows_per_block), [Running("__pos", "count")], True)
    placed = durable(placed.withColumn("__block", F.floor((F.col("__pos") - 1) / rows_per_block).cast("bigint")))
    last_block = placed.agg(F.max("__block")).first()[0] or 0
    own = placed.select(run, "__block", F.col("__pos"), F.col(seq), F.col(value).alias("__x"), F.lit(0).cast("bigint").alias("__below"))
    rows = own if last_block == 0 else own.unionByName(_earlier_values(placed, run, seq, value, rows_per_block))

    schema = T.StructType([df.schema[run], df.schema[seq], T.StructField(name, T.DoubleType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["__pos"].notna()].sort_values("__pos")
        if mine.empty:
            return pd.DataFrame({run: [], seq: [], name: []}).astype({seq: "int64", name: "float64"})
        before = pdf[pdf["__pos"].isna()]
        below = int(before["__below"].iloc[0]) if len(before) else 0
        total = int(mine["__pos"].iloc[0]) - 1
        med = block_medians(before["__x"].dropna().to_numpy(), below, total, mine["__x"].to_numpy())
        return pd.DataFrame({run: mine[run], seq: mine[seq].astype("int64"), name: med})

    return rows.groupBy(run, "__block").applyInPandas(fold, schema)


def _earlier_values(placed: DataFrame, run: str, seq: str, value: str, width: int) -> DataFrame:
    """Per block, the values of earlier blocks that its medians can reach."""
    spark = placed.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Value ranges no larger than a partition; equal values are split by position.
    ranged = range_chunks(placed, [run], [F.col(value), F.col("__pos")]).withColumnRenamed(CHUNK, "__bin")
    cells = ranged.groupBy(run, "__bin", "__block").agg(F.count(F.lit(1)).alias("__n"))
    last = placed.groupBy(run).agg(F.max("__block").alias("__last"))
    grid = (
        cells.select(run, "__bin").distinct().join(last, run)
        .select(run, "__bin", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("__block"))
        .join(cells, [run, "__bin", "__block"], "left")
    )
    prior = W.partitionBy(run, "__bin").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run, "__block").orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
    counts = grid.withColumn("__n", F.coalesce(F.sum("__n").over(prior), F.lit(0))).filter("__block > 0")
    counts = counts.withColumn("__through", F.sum("__n").over(upto)).withColumn("__under", F.col("__through") - F.col("__n"))
    total = F.col("__block") * width
    wanted = counts.filter(
        (F.col("__n") > 0)
        & (F.col("__through") > F.floor((total - width) / 2) - 2)
        & (F.col("__under") <= F.ceil((total + width) / 2) + 2)
    )
    reach = wanted.groupBy(run, "__block").agg(F.min("__under").alias("__below"))
    # Every block asks for the few ranges around the median: salt them so no task serves all blocks.
    asks = wanted.select(run, "__bin", F.col("__block").alias("__for")).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    spread = ranged.select(
        run, "__bin", "__block", F.col(value).alias("__x"), F.pmod(F.xxhash64("__pos"), F.lit(salts)).cast("int").alias("__salt")
    )
    shipped = spread.join(asks, [run, "__bin", "__salt"]).filter("__block < __for").select(run, F.col("__for").alias("__block"), "__x")
    marked = shipped.join(reach, [run, "__block"])
    null_long = F.lit(None).cast("bigint")
    return marked.select(run, "__block", null_long.alias("__pos"), null_long.cast(placed.schema[seq].dataType).alias(seq), "__x", "__below")


def rank_error(k: int) -> float:
    """Share of the rows by which a quantile of a sketch of size ``k`` may miss its rank (99 in 100 times less)."""
    return 2.296 / k**0.9723


def running_median_sketch(
    df: DataFrame, run: str, seq: str, value: str, name: str, k: int = 200, rows_per_block: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``(run, seq, name)`` like ``running_median``, within ``rank_error(k)`` of the middle rank.

    Each block of rows is one sketch; the sketches of the earlier blocks are merged in order, one small row per block, and
    a row's own block is folded in as a running sketch. No value is sent to another block, so the cost stays
    linear for runs of any length.
    """
    placed = running(df.select(run, seq, value), [run], [F.col(seq)], int_chunk(seq, rows_per_block), [Running("__pos", "count")], True)
    placed = durable(placed.withColumn("__block", F.floor((F.col("__pos") - 1) / rows_per_block).cast("bigint")))
    x = F.col(value).cast("double")
    sketches = placed.groupBy(F.col(run).alias("__run"), F.col("__block").alias("__b")).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("__s"))
    earlier = W.partitionBy("__run").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = sketches.select("__run", "__b", F.when(F.col("__b") > 0, F.kll_merge_agg_double("__s", F.lit(k)).over(earlier)).alias("__before"))
    inside = W.partitionBy(run, "__block").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    own = placed.repartition(run, "__block").select(run, "__block", seq, F.kll_sketch_agg_double(x, F.lit(k)).over(inside).alias("__own"))
    both = own.join(carried, F.col(run).eqNullSafe(F.col("__run")) & (F.col("__block") == F.col("__b")))
    merged = F.when(F.col("__before").isNull(), F.col("__own")).otherwise(F.kll_sketch_merge_double("__own", "__before"))
    return both.select(run, seq, F.kll_sketch_get_quantile_double(merged, F.lit(0.5)).alias(name))
