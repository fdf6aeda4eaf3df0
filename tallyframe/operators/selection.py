"""Candidate selection, sampling and few-shot data preparation."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.exprs import digest_fraction, digest_order
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import Running, first_n, hash_chunk, int_chunk, row_numbers, running
from tallyframe.plans.params import MAX_PARAM_ROWS
from tallyframe.sources.variants import field

# ---------------------------------------------------------------- grids


def expand_grid(
    sweeps: Mapping[str, Sequence] | None,
    explicit: Sequence[Mapping] | None = None,
    common: Mapping | None = None,
    required: Sequence[str] = ("model", "strategy"),
) -> tuple[list[dict], list[dict]]:
    """Parameter grid: all sweep combinations (last key fastest), then explicit rows, over ``common``.

    Returns (usable, rejected); rejected rows carry ``missing``. A row's own value wins.
    """
    rows: list[dict] = []
    if sweeps:
        rows += [{**(common or {}), **dict(zip(sweeps, c))} for c in itertools.product(*sweeps.values())]
    for given in explicit or []:
        row = {**(common or {}), **{k: v for k, v in given.items() if k != "name"}}
        if given.get("name"):
            row["_name"] = given["name"]
        rows.append(row)
    if len(rows) > MAX_PARAM_ROWS:
        raise ValueError(f"{len(rows)} configurations is data, not a parameter grid")
    for i, row in enumerate(rows):
        row["config_id"] = i
    lacking = [{**r, "missing": [k for k in required if k not in r]} for r in rows]
    return [r for r in rows if all(k in r for k in required)], [r for r in lacking if r["missing"]]


def grid_eval(examples: DataFrame, configs: Sequence[Mapping], score: Callable[[Column], Column], schema: str) -> DataFrame:
    """Score every example under every configuration; mean score and rows per configuration.

    The grid rides along as a literal array, so there is no join and the mean combines map-side.
    """
    grid = F.from_json(F.lit(json.dumps(list(configs))), f"array<struct<{schema}>>")
    crossed = examples.withColumn("config", F.explode(grid))
    return (
        crossed.groupBy("config")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(score(F.col("config"))).alias("score"))
        .select("config.*", "rows", "score")
    )


# ---------------------------------------------------------------- attempts


def best_attempts(
    attempts: DataFrame, perfect: float = 1.0, max_retries: int = 5, keys: Sequence[str] = ("example_idx", "pred_name")
) -> DataFrame:
    """Best attempt per (example, predictor): first maximum wins, stop after the first perfect one.

    At most ``max_retries`` rows per group reach the aggregate, so the nested list is bounded.
    """
    kept = first_n(attempts, keys, [F.col("attempt")], max_retries)
    rows = F.array_sort(F.collect_list(F.struct("attempt", "instruction", "score", "feedback")))
    seen = kept.groupBy(*keys).agg(rows.alias("__all"))
    stop = F.array_position(F.transform("__all", lambda a: a["score"] >= perfect), True)
    tried = F.slice("__all", F.lit(1), F.when(stop > 0, stop.cast("int")).otherwise(F.size("__all")))
    out = seen.withColumn("attempts", tried)
    scores = F.transform("attempts", lambda a: a["score"])
    out = out.withColumn("best_score", F.array_max(scores))
    at = F.array_position(scores, F.col("best_score")).cast("int")
    return out.select(
        *keys,
        F.element_at("attempts", 1)["instruction"].alias("starting_instruction"),
        F.element_at("attempts", at)["instruction"].alias("final_instruction"),
        "best_score",
        F.size("attempts").cast("bigint").alias("num_attempts"),
        "attempts",
        (F.col("best_score") >= perfect).alias("achieved_perfect"),
    )


def attempt_progress(best: DataFrame, example: str = "example_idx", predictor: str = "pred_name") -> DataFrame:
    """Mean best score and perfect count so far, in (example, predictor) order over the whole history."""
    out = running(
        best,
        [],
        [F.col(example), F.col(predictor)],
        int_chunk(example, 1 << 15),
        [
            Running("done", "count"),
            Running("__sum", "sum", F.col("best_score")),
            Running("perfect_so_far", "sum", F.col("achieved_perfect").cast("bigint")),
        ],
        sparse=True,
    )
    return out.withColumn("avg_so_far", F.col("__sum") / F.col("done")).drop("__sum")


# ---------------------------------------------------------------- candidate scores


def current_best(scores: DataFrame) -> DataFrame:
    """Candidate with the highest mean score; ties go to the lowest index."""
    means = scores.groupBy("candidate").agg(F.avg("score").alias("mean_score"))
    best = means.agg(F.max_by(F.struct("candidate", "mean_score"), F.struct("mean_score", -F.col("candidate"))).alias("b"))
    return best.select("b.*")


def pareto_front(scores: DataFrame, example: str = "row_idx") -> DataFrame:
    """Candidates that reach some example's best score, weighted by how many examples that is."""
    best = scores.groupBy(example, "candidate").agg(F.max("score").alias("score"))
    # One array entry per candidate, so a group is as small as the candidate list.
    per_example = best.groupBy(example).agg(
        F.max("score").alias("top"), F.collect_list(F.struct("candidate", "score")).alias("all")
    )
    winners = per_example.select(F.explode(F.filter("all", lambda c: c["score"] == F.col("top"))).alias("w"))
    return winners.groupBy(F.col("w.candidate").alias("candidate")).agg(F.count(F.lit(1)).alias("weight"))


def pareto_score(scores: DataFrame, example: str = "row_idx") -> DataFrame:
    """Mean over examples of the best score any candidate reached, next to the best single mean."""
    front = scores.groupBy(example).agg(F.max("score").alias("top")).agg(F.avg("top").alias("pareto_score"))
    both = front.unionByName(current_best(scores), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("pareto_score", "candidate", "mean_score")])


def majority(preds: DataFrame, size: int | None = None, seed: int = 0, example: str = "row_idx", answer: str = "pred") -> DataFrame:
    """Majority answer per example, ties to the smallest answer; optionally from ``size`` candidates only."""
    if size is not None:
        chosen = preds.select("candidate").distinct().orderBy(digest_order(seed, "candidate")).limit(size)
        preds = preds.join(chosen, "candidate", "left_semi")
    votes = preds.groupBy(example, answer).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(example).agg(
        F.min_by(answer, F.struct(-F.col("votes"), F.col(answer))).alias("answer"), F.max("votes").alias("votes")
    )


def ensemble(preds: DataFrame, reduce: Column | Callable[[list], object], example: str = "row_idx", answer: str = "pred") -> DataFrame:
    """Combine the candidates' answers per example with a user-supplied reduction.

    An aggregate Column stays in the JVM and combines map-side. A Python ``reduce(answers)`` runs as
    a grouped Arrow aggregate over one answer per candidate.
    """
    if isinstance(reduce, Column):
        return preds.groupBy(example).agg(reduce.alias("answer"))

    @F.pandas_udf(preds.schema[answer].dataType)
    def combine(answers: pd.Series) -> object:
        return reduce(answers.tolist())

    return preds.groupBy(example).agg(combine(answer).alias("answer"))


# ---------------------------------------------------------------- routing and minibatches


def route_by_keys(rules: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """Ordered rules ``(key in output, route)``; the first key present decides."""

    def route(output: Column) -> Column:
        return F.coalesce(*[F.when(field(output, key).isNotNull(), F.lit(name)) for key, name in rules])

    return route


# Named routes of the programs in use; empty until a program registers its own.
ROUTES: dict[str, Callable[[Column], Column]] = {}


def register_route(name: str, rules: Sequence[tuple[str, str]]) -> None:
    """Name the ordered rules of a program's outputs; a second call replaces the first."""
    ROUTES[name] = route_by_keys(rules)


def named_route(name: str) -> Callable[[Column], Column]:
    if name not in ROUTES:
        raise ValueError(f"unknown route {name!r}; available: {', '.join(sorted(ROUTES))}")
    return ROUTES[name]


def route_pools(examples: DataFrame, route: Callable[[Column], Column], output: str = "output") -> DataFrame:
    """Add ``route``; NULL means unroutable (excluded from pools, but countable)."""
    return examples.withColumn("route", route(F.col(output)))


def pool_sizes(routed: DataFrame) -> DataFrame:
    return routed.groupBy(F.coalesce("route", F.lit("unroutable")).alias("route")).agg(F.count(F.lit(1)).alias("size"))


def _epoch_batches(pooled: DataFrame, size: int, seed: int, key: str, most: int | None = None) -> DataFrame:
    """Cut every (route, epoch) into batches in digest order; the incomplete tail is dropped.

    Expects ``route``, ``epoch``, ``pool``. Positions come from digest-prefix chunks, so one huge
    pool is numbered by many tasks. Where only the first ``most`` rows of a (route, epoch) are wanted, the tasks that read
    the pool keep no more than those, and the pool is neither shuffled nor ranked whole.
    """
    tagged = pooled.withColumn("__digest", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", key).cast("binary")))
    keys, order = ["route", "epoch"], [F.col("__digest"), F.col(key)]
    if most is None:
        numbered = row_numbers(tagged, keys, order, "__rn", hash_chunk(F.col("__digest")))
    else:
        numbered = first_n(tagged, keys, order, most, rank="__rn")
    batch = F.floor((F.col("__rn") - 1) / size).cast("bigint")
    whole = (F.col("pool") < size) | ((F.col("batch") + 1) * size <= F.col("pool"))
    return numbered.withColumn("batch", batch).filter(whole).drop("__digest", "__rn")


def minibatches(routed: DataFrame, size: int, seed: int = 0, epochs: int = 1, key: str = "row_idx") -> DataFrame:
    """Route-pure batches per epoch: ``(route, epoch, batch, key)``."""
    pools = routed.filter(F.col("route").isNotNull()).select("route", key)
    sizes = durable(pools.groupBy("route").agg(F.count(F.lit(1)).alias("pool")), "pools")
    spread = pools.join(sizes, "route").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return _epoch_batches(spread, size, seed, key).select("route", F.col("epoch").cast("bigint").alias("epoch"), "batch", key)


def iteration_batches(
    routed: DataFrame, predictors: Sequence[str], size: int, iterations: int, seed: int = 0, key: str = "row_idx"
) -> DataFrame:
    """Batch of every optimizer iteration; iteration ``i`` serves predictor ``i mod n``.

    ``predictors`` is a fixed list of components, in turn order; a component may stand in it more than once, and
    its turns then walk on through the same pool. The iteration number follows from (epoch, batch)
    by arithmetic, so no join with a range is needed. A predictor without a pool gets the first
    ``size`` ids overall.
    """
    n = len(predictors)
    # Turns of a route in one round, and by its t-th turn the iteration: round * n + place in the list.
    places = {p: [i for i, q in enumerate(predictors) if q == p] for p in predictors}
    as_map = lambda value: F.create_map(*[x for p, at in places.items() for x in (F.lit(p), value(at))])
    own = F.element_at(as_map(lambda at: F.array(*[F.lit(i) for i in at])), F.col("route"))
    pools = routed.filter(F.col("route").isin(*predictors)).select("route", key)
    sizes = durable(pools.groupBy("route").agg(F.count(F.lit(1)).alias("pool")), "pools")
    per_epoch = F.greatest(F.floor(F.col("pool") / size), F.lit(1))
    turns = F.aggregate(own, F.lit(0), lambda acc, i: acc + F.greatest(F.ceil((F.lit(iterations) - i) / n), F.lit(0)).cast("int"))
    sizes = sizes.select(
        "route", "pool", per_epoch.cast("bigint").alias("__per"), own.alias("__own"), F.ceil(turns / per_epoch).cast("int").alias("__epochs")
    ).filter("__epochs > 0")
    spread = pools.join(sizes, "route").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    cut = _epoch_batches(spread, size, seed, key, size * iterations)  # no route has more turns
    turn_no, slots = F.col("epoch") * F.col("__per") + F.col("batch"), F.size("__own")
    iteration = F.floor(turn_no / slots) * n + F.get("__own", (turn_no % slots).cast("int"))
    out = cut.select(iteration.cast("bigint").alias("iteration"), "route", key).filter(F.col("iteration") < iterations)
    heads = routed.select(key).orderBy(key).limit(size)  # a batch, by definition small
    turn = F.transform(
        F.sequence(F.lit(0), F.lit(iterations - 1)),
        lambda i: F.struct(
            i.cast("bigint").alias("iteration"),
            F.element_at(F.array(*[F.lit(p) for p in predictors]), (i % n + 1).cast("int")).alias("route"),
        ),
    )
    idle = heads.select(F.explode(turn).alias("t"), key).select("t.*", key).join(sizes.select("route"), "route", "left_anti")
    return out.unionByName(idle.select("iteration", "route", key))


def eval_schedule(
    examples: DataFrame, trials: int, size: int = 35, every: int = 5, seed: int = 0, key: str = "row_idx"
) -> DataFrame:
    """``(trial, kind, key)``: a minibatch per trial and the full set after every ``every`` trials.

    Trials walk through one digest order of the examples, starting a new order when it is used up.
    """
    pool = examples.agg(F.count(F.lit(1))).scalar()
    counted = examples.select(F.lit("all").alias("route"), key, pool.alias("pool"))
    per_epoch = F.greatest(F.floor(F.col("pool") / size), F.lit(1))
    spread = counted.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(trials) / per_epoch).cast("int") - 1)))
    trial = F.col("epoch") * per_epoch + F.col("batch") + 1
    mini = _epoch_batches(spread, size, seed, key, size * trials).select(trial.cast("bigint").alias("trial"), F.lit("minibatch").alias("kind"), key)
    mini = mini.filter(F.col("trial") <= trials)
    if trials < every:
        return mini
    full = examples.select(
        F.explode(F.sequence(F.lit(every), F.lit(trials), F.lit(every))).alias("trial"), F.lit("full").alias("kind"), key
    )
    return mini.unionByName(full.withColumn("trial", F.col("trial").cast("bigint")))


# ---------------------------------------------------------------- demonstrations


def labeled_demos(train: DataFrame, k: int, by: Sequence[str], sample: bool = True, seed: int = 0, key: str = "row_idx") -> DataFrame:
    """``k`` examples per predictor: seeded sample or the first ones."""
    order = [digest_order(seed, key), F.col(key)] if sample else [F.col(key)]
    return first_n(train, by, order, k)


def bootstrap_demos(
    scored: DataFrame,
    labeled: DataFrame,
    threshold: float | None = None,
    max_bootstrapped: int = 4,
    max_labeled: int = 16,
    by: str = "candidate",
    key: str = "row_idx",
) -> DataFrame:
    """Passing traces first (up to ``max_bootstrapped``), then labeled examples up to ``max_labeled``."""
    ok = F.col("score") >= threshold if threshold is not None else F.col("score") > 0
    boot = first_n(scored.filter(ok).select(by, key), [by], [F.col(key)], max_bootstrapped)
    used = boot.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    # Enough per predictor to survive the removal of bootstrapped ones; then remove and trim.
    pool = first_n(labeled.select(by, key).distinct(), [by], [F.col(key)], max_labeled + max_bootstrapped)
    fill = first_n(pool.join(boot, [by, key], "left_anti"), [by], [F.col(key)], max_labeled, rank="__rank")
    room = F.lit(max_labeled) - F.coalesce("__n", F.lit(0))
    fill = fill.join(used, by, "left").filter(F.col("__rank") <= room)
    return boot.withColumn("source", F.lit("bootstrapped")).unionByName(
        fill.select(by, key).withColumn("source", F.lit("labeled"))
    )


def pos_neg(scored: DataFrame, lo: float, hi: float, n: int, by: str = "candidate", key: str = "row_idx") -> DataFrame:
    """Positive and negative examples per predictor, best and worst first, at most ``n`` of each."""
    label = F.when(F.col("score") >= hi, "positive").when(F.col("score") <= lo, "negative")
    marked = scored.withColumn("label", label).filter(F.col("label").isNotNull())
    strength = F.when(F.col("label") == "positive", -F.col("score")).otherwise(F.col("score"))
    return first_n(marked, [by, "label"], [strength, F.col(key)], n)


def holdout(df: DataFrame, ratio: float = 0.1, seed: int = 0, key: str = "row_idx") -> DataFrame:
    """Mark a seeded share as ``val`` by id digest: the same rows whatever the partitioning."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    return df.withColumn("part", F.when(digest_fraction(digest_order(seed, key)) < ratio, "val").otherwise("train"))


def finetune_export(scored: DataFrame, path: str, threshold: float = 1.0, multitask: bool = True, by: str = "candidate") -> None:
    """Passing rows as JSON lines; without ``multitask`` one directory per predictor."""
    passing = scored.filter(F.col("score") >= threshold)
    if multitask:
        passing.write.mode("append").json(path)
    else:
        passing.hint("rebalance", by).write.mode("append").partitionBy(by).json(path)


def reflective_dataset(
    scored: DataFrame, instructions: DataFrame, size: int = 3, skip_perfect: bool = True, perfect: float = 1.0,
    component: str = "component", order: str = "row_idx",
) -> DataFrame:
    """Per component: current instruction and up to ``size`` (inputs, outputs, feedback) records.

    ``size`` is the minibatch, so the list is bounded; components without records drop out.
    """
    rows = scored.filter(F.col("score") < perfect) if skip_perfect else scored
    few = first_n(rows, [component], [F.col(order)], size)
    lists = few.groupBy(component).agg(
        F.array_sort(F.collect_list(F.struct(order, "inputs", "outputs", "feedback"))).alias("records")
    )
    return lists.join(instructions, component)
