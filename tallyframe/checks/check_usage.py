"""C: usage, latency, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.check_scoring import PRICE_TREE, rounded
from tallyframe.checks.registry import check
from tallyframe.operators import usage as us

_TOKENS = ", ".join(
    f"cast(sum(coalesce({c}, 0)) as bigint) as {c}" for c in ("prompt_tokens", "completion_tokens", "total_tokens")
)
_COST = """case when u.cost > 0 then u.cost
  else coalesce(coalesce(u.prompt_tokens, 0) / 1e6 * p.input_per_m + coalesce(u.completion_tokens, 0) / 1e6 * p.output_per_m, 0e0) end"""
_PRICED = "usage_rows u left join prices p on p.model = u.model"


@check("c1_sum_usage", f"select conv_id, {_TOKENS} from usage_rows group by conv_id")
def c1(fx):
    value = F.struct("prompt_tokens", "completion_tokens", "total_tokens", "cost")
    maps = fx.usage_rows.groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", value.alias("u")))).alias("usage")  # five models at most
    )
    return us.sum_usage(us.usage_from_map(maps, "usage", ["conv_id"]), ["conv_id"])


@check(
    "c2_price_dim",
    "select p.*, count(u.model) as uses from prices p left join usage_rows u on u.model = p.model group by all",
)
def c2(fx):
    uses = fx.usage_rows.groupBy("model").agg(F.count(F.lit(1)).alias("uses"))
    out = us.price_dim(fx.spark, PRICE_TREE).join(uses, "model", "left")
    return out.withColumn("uses", F.coalesce("uses", F.lit(0)))


@check("c3_with_prices", f"select u.conv_id, u.model, p.input_per_m, p.output_per_m from {_PRICED}")
def c3(fx):
    return us.with_prices(fx.usage_rows, us.price_dim(fx.spark, PRICE_TREE)).select(
        "conv_id", "model", "input_per_m", "output_per_m"
    )


@check("c4_with_cost", f"select u.conv_id, round(sum({_COST}), 8) as cost from {_PRICED} group by u.conv_id")
def c4(fx):
    return rounded(us.cost_per(fx.usage_rows, us.price_dim(fx.spark, PRICE_TREE), ["conv_id"]), "cost", places=8)


@check(
    "c5_unpriced",
    f"""select u.model, count(*) as rows, cast(sum(u.total_tokens) as bigint) as total_tokens from {_PRICED}
        where p.model is null and not coalesce(u.cost > 0, false) group by u.model""",
)
def c5(fx):
    return us.unpriced(fx.usage_rows, us.price_dim(fx.spark, PRICE_TREE))


# An end belongs to the last event of its call before it, if that is a start.
_CALLS = """c as (select scope, call_id, start_name as name, exception, epoch_us(ts) / 1e6 - epoch_us(start_ts) / 1e6 as latency_seconds
  from (select *, lag(kind) over call as last_kind, lag(ts) over call as start_ts, lag(name) over call as start_name from calls
    window call as (partition by scope, call_id order by ts, kind = 'end')) t where kind = 'end' and last_kind = 'start')"""


@check("c6_pair_calls", f"with {_CALLS} select scope, call_id, name, exception, round(latency_seconds, 6) as latency_seconds from c")
def c6(fx):
    return rounded(
        us.pair_calls(fx.calls).select("scope", "call_id", "name", "exception", "latency_seconds"), "latency_seconds"
    )


@check(
    "c7_lm_latency",
    f"""with {_CALLS} select name, count(*) as calls, count(case when exception then 1 end) as failed,
        round(sum(latency_seconds), 4) as total_seconds, round(avg(latency_seconds), 6) as mean_seconds from c group by name""",
)
def c7(fx):
    return rounded(rounded(us.lm_latency(us.pair_calls(fx.calls), ["name"]), "mean_seconds"), "total_seconds", places=4)


@check(
    "c8_module_stats",
    f"""with {_CALLS} select name, count(*) as calls, round(sum(latency_seconds), 4) as total_seconds, round(avg(latency_seconds), 6) as mean_seconds,
        round(min(latency_seconds), 6) as min_seconds, round(max(latency_seconds), 6) as max_seconds from c group by name""",
)
def c8(fx):
    out = us.module_stats(us.pair_calls(fx.calls))
    return rounded(rounded(out, "mean_seconds", "min_seconds", "max_seconds"), "total_seconds", places=4)


@check(
    "c9_cost_per_1k",
    """select run_id, count(*) as rows, round(sum(cost), 6) as cost, round(sum(cost) * 1000 / count(*), 4) as cost_per_1k_rows
       from eval_results group by run_id""",
)
def c9(fx):
    summary = fx.eval_results.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost").alias("cost"))
    return rounded(us.cost_per_1k(summary), "cost")


@check(
    "c10_cost_rollup",
    f"""
with t as (select u.conv_id, 'r' || cast(u.conv_id % 2 as varchar) as repo_id, 'p' || cast(u.conv_id % 3 as varchar) as program,
    'v' || cast(u.conv_id % 2 as varchar) as version, 'run' || cast(u.conv_id % 10 as varchar) as run, sum({_COST}) as cost
  from {_PRICED} group by u.conv_id)
select repo_id, program, version, run, round(sum(cost), 8) as cost, count(*) as traces,
  (case when grouping(repo_id) = 0 then 1 else 0 end + case when grouping(program) = 0 then 1 else 0 end
   + case when grouping(version) = 0 then 1 else 0 end + case when grouping(run) = 0 then 1 else 0 end)::bigint as level
from t group by rollup (repo_id, program, version, run)""",
)
def c10(fx):
    per_trace = us.cost_per(fx.usage_rows, us.price_dim(fx.spark, PRICE_TREE), ["conv_id"])
    tag = lambda p, n: F.concat(F.lit(p), (F.col("conv_id") % n).cast("string"))
    labelled = per_trace.withColumns({"repo_id": tag("r", 2), "program": tag("p", 3), "version": tag("v", 2), "run": tag("run", 10)})
    return rounded(us.cost_rollup(labelled), "cost", places=8)
