"""Token usage, prices, cost and latency of model calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from tallyframe.plans.params import param_table

_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_from_map(df: DataFrame, usage: str, keys: Sequence[str]) -> DataFrame:
    """``map<model, struct<tokens.., cost>>`` to one row per model."""
    return df.select(*keys, F.explode(usage).alias("model", "__u")).select(*keys, "model", "__u.*")


def sum_usage(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token sums over models; a missing count is 0 and totals are summed, not recomputed."""
    return usage.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in _TOKENS])


def price_leaves(tree: Mapping) -> list[tuple[str, float, float]]:
    """Price tree (a parameter) to ``(path, input_per_m, output_per_m)``.

    A leaf holds both prices; keys starting with ``_`` are metadata.
    """
    found: list[tuple[str, float, float]] = []
    todo = [((), tree)]
    while todo:
        path, node = todo.pop()
        if "input" in node and "output" in node and path:
            if node["input"] is not None and node["output"] is not None:
                found.append(("/".join(path), float(node["input"]), float(node["output"])))
        todo += [((*path, k), v) for k, v in node.items() if isinstance(v, Mapping) and not k.startswith("_")]
    return sorted(found)


def price_dim(spark: SparkSession, tree: Mapping) -> DataFrame:
    return param_table(spark, price_leaves(tree), "model string, input_per_m double, output_per_m double")


def with_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Exact full-path match; models without a price keep NULL prices."""
    return usage.join(prices, "model", "left")


def _reported():
    return F.col("cost") > 0


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model row: reported if > 0, else tokens x price, else 0."""
    priced = F.coalesce(F.col("prompt_tokens"), F.lit(0)) / 1e6 * F.col("input_per_m") + F.coalesce(
        F.col("completion_tokens"), F.lit(0)
    ) / 1e6 * F.col("output_per_m")
    value = F.when(_reported(), F.col("cost")).otherwise(F.coalesce(priced, F.lit(0.0)))
    return with_prices(usage, prices).withColumn("model_cost", value).drop("input_per_m", "output_per_m")


def cost_per(usage: DataFrame, prices: DataFrame, by: Sequence[str]) -> DataFrame:
    return with_cost(usage, prices).groupBy(*by).agg(F.sum("model_cost").alias("cost"))


def unpriced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that silently count as free: no reported cost and no price."""
    free = usage.filter(~F.coalesce(_reported(), F.lit(False))).join(prices, "model", "left_anti")
    return free.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens")
    )


def pair_calls(events: DataFrame, keys: Sequence[str] = ("scope", "call_id")) -> DataFrame:
    """Start and end events of a call in one ordered pass (no self join); unpaired ones drop out.

    An end pairs with the event right before it if that is a start: a repeated start replaces the
    earlier one, a repeated end is ignored, and an id may be used again. A group is one call's events.
    """
    known = events
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    # At equal times a start comes before its end.
    w = W.partitionBy(*keys).orderBy("ts", F.when(F.col("kind") == "start", 0).otherwise(1))
    before = known.withColumn("__b", F.lag(F.struct("kind", "ts", "name")).over(w))
    paired = before.filter((F.col("kind") == "end") & (F.col("__b.kind") == "start"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return paired.select(
        *keys, F.col("__b.name").alias("name"), F.col("__b.ts").alias("started_at"), F.col("ts").alias("ended_at"), "exception"
    ).withColumn("latency_seconds", (micros("ended_at") - micros("started_at")) / 1e6)


def lm_latency(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Call count (failed ones too), total and mean latency; mean is 0 without calls."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("exception"), 1)).alias("failed"),
        F.coalesce(F.sum("latency_seconds"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.avg("latency_seconds"), F.lit(0.0)).alias("mean_seconds"),
    )


def module_stats(calls: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    x = "latency_seconds"
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(x).alias("total_seconds"),
        F.avg(x).alias("mean_seconds"),
        F.min(x).alias("min_seconds"),
        F.max(x).alias("max_seconds"),
    )


def cost_per_1k(summary: DataFrame, cost: str = "cost", rows: str = "rows") -> DataFrame:
    value = F.round(F.col(cost) * 1000 / F.nullif(F.col(rows), F.lit(0)), 4)
    return summary.withColumn("cost_per_1k_rows", value)


def cost_rollup(costs: DataFrame, levels: Sequence[str] = ("repo_id", "program", "version", "run")) -> DataFrame:
    """Subtotals at every level; ``level`` is the number of level columns in use.

    The finest level is summed once and the subtotals are built from those sums.
    """
    finest = costs.groupBy(*levels).agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("traces"))
    rolled = finest.rollup(*levels).agg(
        F.sum("cost").alias("cost"),
        F.sum("traces").alias("traces"),
        F.grouping_id().alias("__g"),
    )
    ones = F.bit_count(F.col("__g"))
    return rolled.withColumn("level", (F.lit(len(levels)) - ones).cast("bigint")).drop("__g")
