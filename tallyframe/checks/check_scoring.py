"""B and M: batch scoring, run metrics and user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.operators import examples as ex, logs, scoring as sc, usage as us

PRICE_TREE = {
    "_source": "invented",
    "acme": {"small": {"input": 0.25, "output": 1.5}, "large": {"input": 3.0, "output": 12.0}},
    "hub": {"acme": {"small": {"input": 0.2, "output": 1.25}}, "broken": {"input": 1.0}},
}


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@check(
    "flagship_split_evaluation",
    """
with t as (
  select e.lang as run_id, e.row_idx, e.n_chars, case when e.n_chars > 200 then 1 else 0 end as pred, e.gold
  from splits s join examples e on e.row_idx = s.row_idx where s.split = 'test'),
s as (select *, case when pred = gold then 1e0 else 0e0 end as score, (n_chars % 997) / 1000e0 as latency,
    case when row_idx % 4 = 1 then n_chars / 1e6 * 3 + (n_chars % 101) / 1e6 * 12
      else n_chars / 1e6 * 0.25 + (n_chars % 101) / 1e6 * 1.5 end as cost from t)
select run_id, count(*) as rows, round(sum(score) / count(*) * 100, 6) as score_pct, 0::bigint as errors,
  cast(sum(n_chars) as bigint) as tokens_in, cast(sum(n_chars % 101) as bigint) as tokens_out, round(sum(cost), 8) as cost,
  round(avg(latency) * 1000, 6) as latency_avg_ms, round(median(latency) * 1000, 6) as latency_med_ms,
  round(var_samp(latency) * 1e6, 4) as latency_var_ms2
from s group by run_id""",
)
def flagship(fx):
    """Split selection, rule predictor, equality metric, token pricing, run summary."""
    test = ex.select_split(fx.examples, fx.splits, "test")
    predicted = sc.apply_predictor(test, F.when(F.col("n_chars") > 200, 1).otherwise(0), ["input_text"])
    scored = sc.score(predicted, (F.col("prediction").cast("int") == F.col("gold")).cast("double"))
    used = scored.withColumns(
        {
            "model": F.when(F.col("row_idx") % 4 == 1, "acme/large").otherwise("acme/small"),
            "prompt_tokens": F.col("n_chars"),
            "completion_tokens": F.col("n_chars") % 101,
            "latency": (F.col("n_chars") % 997) / 1000,
            "cost": F.lit(None).cast("double"),
        }
    )
    priced = us.with_cost(used, us.price_dim(fx.spark, PRICE_TREE))
    rows = priced.select(
        F.col("lang").alias("run_id"), "score", "latency", F.col("model_cost").alias("cost"),
        F.col("prompt_tokens").alias("tokens_in"), F.col("completion_tokens").alias("tokens_out"), "error",
    )
    out = sc.run_summary(rows)
    out = rounded(rounded(out, "cost", places=8), "latency_var_ms2", places=4)
    return rounded(out, "score_pct", "latency_avg_ms", "latency_med_ms")


@check(
    "b1_apply_predictor",
    """select row_idx, case when row_idx % 11 = 0 then null else upper(lang) || ':' || cast(length(input_text) as varchar) end as prediction,
       case when row_idx % 11 = 0 then 0 else length(input_text) end as tokens_in,
       case when row_idx % 11 = 0 then 'no answer' end as error from examples""",
)
def b1(fx):
    def program(row_idx, lang, input_text):
        if row_idx % 11 == 0:
            raise ValueError("no answer")
        return {"prediction": f"{lang.upper()}:{len(input_text)}", "tokens_in": len(input_text)}

    out = sc.apply_predictor(fx.examples, program, ["row_idx", "lang", "input_text"])
    return out.select("row_idx", "prediction", "tokens_in", "error")


@check(
    "b2_score",
    """select candidate, row_idx, case when error is null and row_idx % 5 <> 1 then case when pred = gold then 1e0 else 0e0 end else 0e0 end as score,
       case when error is null and row_idx % 5 <> 1 then 0.25e0 else 0e0 end as cost,
       case when error is null and row_idx % 5 <> 1 then 7 else 0 end as tokens_in,
       coalesce(error, case when row_idx % 5 = 1 then 'bad gold' end) as error from predictions""",
)
def b2(fx):
    rows = fx.predictions.drop("score").withColumns({"cost": F.lit(0.25), "tokens_in": F.lit(7)})
    out = sc.score(
        rows, (F.col("pred") == F.col("gold")).cast("double"), F.when(F.col("row_idx") % 5 == 1, "bad gold")
    )
    return out.select("candidate", "row_idx", "score", "cost", "tokens_in", "error")


@check(
    "m1_python_metric",
    """select candidate, row_idx, case when row_idx % 5 = 1 then 0e0 else case when pred = gold then 1e0 else 0e0 end end as score,
       case when row_idx % 5 <> 1 then 'gold ' || cast(gold as varchar) end as feedback,
       case when row_idx % 5 = 1 then 'bad gold' end as error from predictions""",
)
def m1(fx):
    def metric(example, prediction):
        if example["row_idx"] % 5 == 1:
            raise ValueError("bad gold")
        return {"score": float(int(prediction) == example["gold"]), "feedback": f"gold {example['gold']}"}

    rows = fx.predictions.drop("score", "error").withColumn("prediction", F.col("pred").cast("string"))
    out = sc.score(rows, sc.python_metric(metric)(F.struct("row_idx", "gold"), "prediction"))
    return out.select("candidate", "row_idx", "score", "feedback", "error")


@check(
    "b3_normalize_metric",
    """
with t as (select doc_id, doc_id % 7 as k, quality from labels)
select doc_id,
  case k when 0 then cast(quality as double) when 1 then quality / 8e0 when 2 then 1e0 when 3 then 0.5e0 when 4 then 0.00002e0 end as score,
  case k when 0 then 'This trajectory got a score of ' || (case when quality = 1 then '1.0' else '0.0' end) || '.'
    when 1 then 'This trajectory got a score of ' || (case when quality = 1 then '0.125' else '0.0' end) || '.'
    when 2 then 'This trajectory got a score of 1.0.' when 3 then 'good' when 4 then 'This trajectory got a score of 2e-05.' end as feedback,
  case k when 5 then 'missing score' when 6 then 'unsupported metric output' end as problem
from t""",
)
def b3(fx):
    q = F.col("quality").cast("string")
    k = F.col("doc_id") % 7
    raw = (
        F.when(k == 0, q)
        .when(k == 1, F.concat(F.lit('{"score":'), F.when(F.col("quality") == 1, "0.125").otherwise("0.0"), F.lit("}")))
        .when(k == 2, F.lit("true"))
        .when(k == 3, F.lit('{"score":0.5,"feedback":"good"}'))
        .when(k == 4, F.lit('{"score":0.00002,"feedback":null}'))
        .when(k == 5, F.lit('{"feedback":"x"}'))
        .otherwise(F.lit('"text"'))
    )
    out = sc.normalize_metric(fx.labels.select("doc_id", F.parse_json(raw).alias("out")), "out")
    return out.select("doc_id", "score", "feedback", "problem")


@check(
    "a7_load_completed",
    """select run_id, count(*) as completed, round(sum(score), 6) as score_sum, round(sum(latency), 6) as latency_sum,
       cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, round(sum(cost), 6) as cost
       from eval_results where example_idx % 13 <> 5 group by run_id""",
)
def a7(fx):
    r = fx.eval_results
    none = F.col("example_idx") % 13 == 5
    copies = r.withColumn("seq", F.col("seq") + 10**9)
    rows = r.withColumn("example_idx", F.when(~none, F.col("example_idx"))).union(
        copies.withColumn("example_idx", F.when(~none, F.col("example_idx")))
    )
    return rounded(sc.load_completed(rows), "score_sum", "latency_sum", "cost")


@check(
    "b4_remaining",
    """select lang as run_id, row_idx as example_idx from examples
       where row_idx not in (select example_idx from eval_results where error is null)""",
)
def b4(fx):
    todo = fx.examples.select(F.col("lang").alias("run_id"), F.col("row_idx").alias("example_idx"))
    return sc.remaining(todo, fx.eval_results.filter("error is null"))


_SUMMARY_SQL = """select run_id, count(*) as rows, round(sum(score) / count(*) * 100, 6) as score_pct, count(error) as errors,
  cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, round(sum(cost), 6) as cost,
  round(avg(latency) * 1000, 6) as latency_avg_ms, round(median(latency) * 1000, 6) as latency_med_ms,
  round(var_samp(latency) * 1e6, 4) as latency_var_ms2 from eval_results {where} group by run_id"""


def _summary(fx, ok_only):
    out = rounded(sc.run_summary(fx.eval_results, ok_only=ok_only), "score_pct", "cost", "latency_avg_ms", "latency_med_ms")
    return rounded(out, "latency_var_ms2", places=4)


@check("b5_run_summary", _SUMMARY_SQL.format(where=""))
def b5(fx):
    return _summary(fx, False)


@check("b5_run_summary_ok_only", _SUMMARY_SQL.format(where="where error is null"))
def b5_ok(fx):
    return _summary(fx, True)


_PROGRESS = """
w as (select *, count(*) over w as completed, count(*) over (partition by run_id) as total,
    sum(score) over w / count(*) over w * 100 as accuracy_pct, sum(tokens_in) over w as run_tokens_in,
    sum(tokens_out) over w as run_tokens_out, sum(cost) over w as run_cost, avg(latency) over w * 1000 as latency_avg_ms,
    median(latency) over w * 1000 as latency_med_ms, var_samp(latency) over w * 1e6 as latency_var_ms2,
    sum(latency) over w / count(*) over w * (count(*) over (partition by run_id) - count(*) over w) as eta_s
  from eval_results window w as (partition by run_id order by seq rows between unbounded preceding and current row))"""


@check(
    "b6_running_progress",
    f"""with {_PROGRESS}
select run_id, seq, completed, total, round(accuracy_pct + 1e-8, 6) as accuracy_pct, cast(run_tokens_in as bigint) as run_tokens_in,
  cast(run_tokens_out as bigint) as run_tokens_out, round(run_cost, 6) as run_cost, round(latency_avg_ms + 1e-8, 6) as latency_avg_ms,
  round(latency_med_ms, 6) as latency_med_ms, round(latency_var_ms2, 4) as latency_var_ms2, round(eta_s + 1e-8, 6) as eta_s from w""",
)
def b6(fx):
    out = sc.running_progress(fx.eval_results)
    # Both sides move off exact decimal ties before rounding.
    out = out.withColumns({c: F.col(c) + 1e-8 for c in ("accuracy_pct", "latency_avg_ms", "eta_s")})
    out = rounded(rounded(out, "accuracy_pct", "run_cost", "latency_avg_ms", "latency_med_ms", "eta_s"), "latency_var_ms2", places=4)
    return out.select(
        "run_id", "seq", "completed", "total", "accuracy_pct", "run_tokens_in", "run_tokens_out", "run_cost",
        "latency_avg_ms", "latency_med_ms", "latency_var_ms2", "eta_s",
    )


@check(
    "b6_running_progress_sketch",
    """select run_id, count(*) as rows, cast(sum(tokens_in) as bigint) as run_tokens_in, true as within from eval_results group by run_id""",
)
def b6_sketch(fx):
    """The last state of each run; how far the sketched median's rank is off is counted and held to the stated error."""
    last = sc.running_progress(fx.eval_results, sketch=200).filter("completed = total")
    med = F.col("latency_med_ms") / 1000
    lat = F.coalesce("latency", F.lit(0.0))
    both = fx.eval_results.select(F.col("run_id").alias("r2"), lat.alias("x")).join(last, F.col("r2").eqNullSafe(F.col("run_id")))
    counts = both.groupBy("run_id", "run_tokens_in", "latency_rank_error").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("x") < med - 1e-9, 1)).alias("below"), F.count(F.when(F.col("x") <= med + 1e-9, 1)).alias("upto")
    )
    half, slack = F.col("rows") / 2, F.col("rows") * F.col("latency_rank_error") + 1
    return counts.select("run_id", "rows", "run_tokens_in", ((F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("within"))


@check(
    "b7_status_line",
    f"""with {_PROGRESS}
select run_id, seq, completed as done, total, true as parsed, cast(run_tokens_in + run_tokens_out as bigint) as tokens_total,
  round(round(latency_med_ms / 10), 0) as med_tens, case when eta_s < 59.4 then 's' when eta_s > 60 then 'm' end as eta_unit from w""",
)
def b7(fx):
    """Round trip: the formatted line parsed again gives the running numbers."""
    parsed = logs.parse_status(sc.status_line(sc.running_progress(fx.eval_results)).select("run_id", "seq", "eta_s", "latency_med_ms", "line"))
    unit = F.substring("eta", -1, 1)
    return parsed.select(
        "run_id", "seq", F.col("rows_done").alias("done"), F.col("rows_total").alias("total"),
        (F.abs(F.col("latency_med_ms") - F.col("med_ms")) <= 0.5).alias("parsed"), "tokens_total",
        F.round(F.col("latency_med_ms") / 10).alias("med_tens"),
        F.when((F.col("eta_s") < 59.4) | (F.col("eta_s") > 60), unit).alias("eta_unit"),
    )


@check(
    "b8_eval_summary",
    """select run_id, count(score) as rows, coalesce(round(avg(score) * 100, 2), 0e0) as score_pct
       from (select run_id, case when error is null then score end as score from eval_results) t group by run_id""",
)
def b8(fx):
    return sc.eval_summary(fx.eval_results.withColumn("score", F.when(F.col("error").isNull(), F.col("score"))))


@check(
    "b9_score_distinct",
    "select doc_id, length(text) % 10 as score, count(*) over (partition by text, lang) > 0 as scored from documents",
)
def b9(fx):
    out = sc.score_distinct(fx.documents, ["text", "lang"], lambda d: d.withColumn("score", F.length("text").cast("bigint") % 10))
    return out.select("doc_id", "score", F.col("score").isNotNull().alias("scored"))


@check(
    "b10_error_budget",
    """select run_id, seq, cast(errors_before as bigint) as errors_before from (select *, coalesce(sum(case when error is not null then 1 else 0 end)
         over (partition by run_id order by seq rows between unbounded preceding and 1 preceding), 0) as errors_before from eval_results) t
       where errors_before <= 5""",
)
def b10(fx):
    return sc.within_error_budget(fx.eval_results, 5).select("run_id", "seq", "errors_before")


@check(
    "b11_score_by_split",
    """select candidate, round(avg(case when split='train' then score end), 6) as train_score, round(avg(case when split='val' then score end), 6) as val_score,
       round(avg(case when split='test' then score end), 6) as test_score,
       round(avg(case when split='train' then score end) - avg(case when split='val' then score end), 6) as gap from predictions group by candidate""",
)
def b11(fx):
    return rounded(sc.score_by_split(fx.predictions), "train_score", "val_score", "test_score", "gap")
