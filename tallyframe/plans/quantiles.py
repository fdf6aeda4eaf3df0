"""Exact quantiles without holding a group's values in one place.

``median`` and ``percentile`` keep a map of all distinct values of a group in one buffer. Here a
mergeable sketch brackets each wanted rank (its rank error is bounded, so the bracket is certain),
and only the rows inside a bracket are shuffled and counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import Running, running

ACCURACY = 10_000
# Bracket half-widths by group size: each covers two ranks for interpolation, the first also the
# sketch's rank error of N / ACCURACY (below ACCURACY rows the sketch is exact). Smaller groups are
# counted whole.
_WIDTHS = ((4_000, 5 / ACCURACY), (400, 0.005), (40, 0.05))
_SLICES = 16


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of key columns with their copies ``<prefix>0, <prefix>1, ...``."""
    match = F.col(keys[0]).eqNullSafe(F.col(f"{prefix}0"))
    for i, k in enumerate(keys[1:], 1):
        match = match & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return match


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, points: Mapping[str, float], stats: Sequence[Column] = ()
) -> DataFrame:
    """``(keys.., stats.., points..)``: interpolated quantiles per key, NULLs ignored; at least one key.

    Two passes over ``df``: the first computes the sketch together with the caller's other
    aggregates, the second counts values inside the brackets. Both combine map-side.
    """
    keys, wanted = list(keys), sorted(set(points.values()))
    vals = df.withColumn("__x", value.cast("double"))
    clip = lambda p: F.lit(min(1.0, max(0.0, p)))
    fine = _WIDTHS[0][1]
    cuts = [clip(p - fine + 2 * fine * i / _SLICES) for p in wanted for i in range(_SLICES + 1)]
    edges = [clip(p + sign * width) for _, width in _WIDTHS for p in wanted for sign in (-1, 1)]
    first = durable(
        vals.groupBy(*keys).agg(
            F.percentile_approx("__x", F.array(*cuts, *edges), ACCURACY).alias("__cuts"),
            F.count("__x").alias("__n"),
            *stats,
        ),
        "brackets",
    )

    def edge(j: int, side: int) -> Column:
        """Lower (0) or upper (1) end of bracket ``j``, from the narrowest width the group size allows."""
        at = [len(cuts) + level * 2 * len(wanted) + 2 * j + side + 1 for level in range(len(_WIDTHS))]
        pick = F.when(F.col("__n") >= _WIDTHS[0][0], F.try_element_at("__cuts", F.lit(at[0])))
        for i, (rows, _) in zip(at[1:], _WIDTHS[1:]):
            pick = pick.when(F.col("__n") >= rows, F.try_element_at("__cuts", F.lit(i)))
        return pick

    brackets = first.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        "__n",
        F.when(F.col("__n") >= _WIDTHS[0][0], F.array_sort(F.slice("__cuts", 1, len(cuts)))).alias("__cuts"),
        *[edge(j, side).alias(f"__e{j}{side}") for j in range(len(wanted)) for side in (0, 1)],
    )
    placed = vals.filter(F.col("__x").isNotNull()).select(*keys, "__x").join(brackets, same_keys(keys, "__k"))
    x, whole = F.col("__x"), F.col("__e00").isNull()
    inside, passed = whole, F.lit(0)
    for j in range(len(wanted)):
        inside = inside | x.between(F.col(f"__e{j}0"), F.col(f"__e{j}1"))
        passed = passed + F.when(x > F.col(f"__e{j}1"), 1).otherwise(0)
    # Slices rise with the value: gap, bracket, gap, ... and inside a large group's bracket its cuts.
    # Rows outside every bracket collapse to one count per gap; equal values collapse map-side.
    finer = F.when(inside & F.col("__cuts").isNotNull(), F.size(F.filter("__cuts", lambda c: c < x))).otherwise(0)
    slice_no = (2 * passed + inside.cast("int")) * (len(cuts) + 1) + finer
    counted = durable(
        placed.filter(whole | (x <= F.col(f"__e{len(wanted) - 1}1")))
        .groupBy(*keys, "__n", slice_no.alias("__slice"), F.when(inside, x).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c")),
        "counted",
    )
    ranked = running(counted, keys, ["__v"], F.col("__slice"), [Running("__upto", "sum", F.col("__c"))])

    def at_rank(rank: Column) -> Column:
        """Value at a rank; fails if the rank fell between the brackets instead of inside one."""
        reached = F.col("__upto") >= rank
        first = F.min(F.when(reached, F.col("__upto")))
        certain = first == F.min(F.when(reached & F.col("__v").isNotNull(), F.col("__upto")))
        found = F.min(F.when(reached, F.col("__v")))
        return F.when(F.coalesce(certain, F.lit(False)), found).otherwise(F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))

    picks = []
    for name, p in points.items():
        spot = (F.col("__n") - 1) * p + 1
        low, high = at_rank(F.floor(spot)), at_rank(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        picks.append((low + (high - low) * part).alias(name))
    found = ranked.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*picks)
    out = first.join(found, same_keys(keys, "__k"), "left")
    return out.drop("__cuts", "__n", *[f"__k{i}" for i in range(len(keys))])


def exact_median(df: DataFrame, keys: Sequence[str], value: Column, name: str, stats: Sequence[Column] = ()) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, stats)
