"""D: candidate selection, sampling, few-shot preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.check_scoring import rounded
from tallyframe.checks.registry import check
from tallyframe.operators import ann, neighbors as nb, selection as sel
from tallyframe.plans.durable import durable, scratch

SWEEPS = {"model": ["acme/small", "acme/large"], "k": [1, 4, 16]}
EXPLICIT = [{"name": "base", "model": "acme/small"}, {"name": "off", "k": 2}]
COMMON = {"k": 4, "strategy": "plain"}


@check(
    "d1_grid_eval",
    """
with g(config_id, _name, model, k, strategy) as (values (0, null, 'acme/small', 1, 'plain'), (1, null, 'acme/small', 4, 'plain'),
  (2, null, 'acme/small', 16, 'plain'), (3, null, 'acme/large', 1, 'plain'), (4, null, 'acme/large', 4, 'plain'),
  (5, null, 'acme/large', 16, 'plain'), (6, 'base', 'acme/small', 4, 'plain'))
select g.*, count(*) as rows, round(avg(case when (n_chars > 100 * k) = (coalesce(gold, 0) = 1) then 1e0 else 0e0 end), 6) as score
from examples, g group by all""",
)
def d1(fx):
    usable, _rejected = sel.expand_grid(SWEEPS, EXPLICIT, COMMON)
    hit = lambda c: ((F.col("n_chars") > 100 * c["k"]) == (F.coalesce("gold", F.lit(0)) == 1)).cast("double")
    out = sel.grid_eval(fx.examples, usable, hit, "config_id:int,_name:string,model:string,k:int,strategy:string")
    return rounded(out, "score")


_BEST = """
a as (select *, row_number() over (partition by example_idx, pred_name order by attempt) as rn from attempts),
b as (select *, coalesce(max(score) over (partition by example_idx, pred_name order by rn rows between unbounded preceding and 1 preceding), -1e0) as before
  from a where rn <= 5),
c as (select * from b where before < 1e0),
best as (select example_idx, pred_name, arg_min(instruction, rn) as starting_instruction,
  arg_max(instruction, score * 1000 - rn) as final_instruction, max(score) as best_score, count(*) as num_attempts,
  string_agg(instruction, ',' order by rn) as tried, max(score) >= 1e0 as achieved_perfect
  from c group by example_idx, pred_name)"""


@check("d2_best_attempts", f"with {_BEST} select * from best")
def d2(fx):
    best = sel.best_attempts(fx.attempts, perfect=1.0, max_retries=5)
    return best.withColumn("tried", F.array_join(F.transform("attempts", lambda a: a["instruction"]), ",")).drop("attempts")


@check(
    "d3_attempt_progress",
    f"""with {_BEST} select example_idx, pred_name, count(*) over w as done, round(avg(best_score) over w + 1e-8, 6) as avg_so_far,
        cast(sum(case when achieved_perfect then 1 else 0 end) over w as bigint) as perfect_so_far from best
        window w as (order by example_idx, pred_name rows between unbounded preceding and current row)""",
)
def d3(fx):
    out = sel.attempt_progress(sel.best_attempts(fx.attempts))
    # Both sides move off exact decimal ties before rounding.
    out = out.withColumn("avg_so_far", F.round(F.col("avg_so_far") + 1e-8, 6))
    return out.select("example_idx", "pred_name", "done", "avg_so_far", "perfect_so_far")


@check(
    "d4_current_best",
    """select candidate, round(m, 6) as mean_score from (select candidate, avg(score) as m from predictions where split = 'val' group by candidate) t
       order by m desc, candidate limit 1""",
)
def d4(fx):
    return rounded(sel.current_best(fx.predictions.filter("split = 'val'")), "mean_score")


@check(
    "d5_pareto_front",
    """select candidate, count(*) as weight from (select candidate, score, max(score) over (partition by row_idx) as top from predictions) t
       where score = top group by candidate""",
)
def d5(fx):
    return sel.pareto_front(fx.predictions)


@check(
    "d6_pareto_score",
    """select round((select avg(t) from (select max(score) as t from predictions group by row_idx) x), 6) as pareto_score, candidate, round(m, 6) as mean_score
       from (select candidate, avg(score) as m from predictions group by candidate) y order by m desc, candidate limit 1""",
)
def d6(fx):
    return rounded(sel.pareto_score(fx.predictions), "pareto_score", "mean_score")


@check(
    "d7_majority",
    """select row_idx, pred as answer, n as votes from (select *, row_number() over (partition by row_idx order by n desc, pred) as r
       from (select row_idx, pred, count(*) as n from predictions group by row_idx, pred) t) u where r = 1""",
)
def d7(fx):
    return sel.majority(fx.predictions)


@check(
    "d7_majority_subset",
    """with c as (select candidate from (select distinct candidate from predictions) t order by md5('5:' || cast(candidate as varchar)) limit 3)
       select row_idx, pred as answer, n as votes from (select *, row_number() over (partition by row_idx order by n desc, pred) as r
       from (select row_idx, pred, count(*) as n from predictions where candidate in (select candidate from c) group by row_idx, pred) t) u where r = 1""",
)
def d7_subset(fx):
    return sel.majority(fx.predictions, size=3, seed=5)


_ENSEMBLE = "select row_idx, max(pred) as answer from predictions group by row_idx"


@check("m4_ensemble_column", _ENSEMBLE)
def m4(fx):
    return sel.ensemble(fx.predictions, F.max("pred"))


@check("m4_ensemble_python", _ENSEMBLE)
def m4_python(fx):
    return sel.ensemble(fx.predictions, max)


def _routed(fx):
    out = (
        F.when(F.col("row_idx") % 9 == 0, '{"summary":"hi","lookup":null}')
        .when(F.col("row_idx") % 3 == 0, '{"lookup":"x"}')
        .when(F.col("row_idx") % 3 == 1, '{"summary":"hi"}')
        .when(F.col("row_idx") % 11 == 0, '{"handoff":1}')
        .otherwise("{}")
    )
    rows = fx.examples.select("row_idx", F.parse_json(out).alias("output"))
    sel.register_route("lookup_or_summary", [("lookup", "search"), ("summary", "write.final")])
    return sel.route_pools(rows, sel.named_route("lookup_or_summary"))


_ROUTED = """r as (select row_idx, case when row_idx % 3 = 0 then 'search' when row_idx % 3 = 1 then 'write.final' end as route from examples)"""


@check("d8_route_pools", f"with {_ROUTED} select coalesce(route, 'unroutable') as route, count(*) as size from r group by 1")
def d8(fx):
    return sel.pool_sizes(_routed(fx))


_BATCHES = f"""{_ROUTED},
n as (select *, count(*) over (partition by route) as pool from r where route is not null),
o as (select n.*, epoch, row_number() over (partition by route, epoch order by md5('3:' || cast(epoch as varchar) || ':' || cast(row_idx as varchar)), row_idx) as rn
  from n, (select unnest(range({{epochs}})) as epoch) e),
b as (select *, cast(floor((rn - 1) / {{size}}e0) as bigint) as batch from o),
m as (select * from b where pool < {{size}} or (batch + 1) * {{size}} <= pool)"""


@check("d9_minibatches", f"with {_BATCHES.format(epochs=3, size=8)} select route, epoch, batch, row_idx from m")
def d9(fx):
    return sel.minibatches(_routed(fx), size=8, seed=3, epochs=3)


@check(
    "d9_iteration_batches",
    f"""with {_BATCHES.format(epochs=1, size=4)}
select iteration, route, row_idx from (select batch * 3 + case route when 'search' then 0 else 1 end as iteration, route, row_idx from m) t where iteration < 40
union all select i, 'idle', row_idx from (select unnest(range(2, 40, 3)) as i) s, (select row_idx from r order by row_idx limit 4) h""",
)
def d9_iterations(fx):
    return sel.iteration_batches(
        _routed(fx), ["search", "write.final", "idle"], size=4, iterations=40, seed=3
    )


@check(
    "d11_labeled_demos",
    """select candidate, row_idx from (select candidate, row_idx, row_number() over (partition by candidate order by md5('1:' || cast(row_idx as varchar)), row_idx) as r
       from predictions) t where r <= 8""",
)
def d11(fx):
    return sel.labeled_demos(fx.predictions, 8, ["candidate"], seed=1).select("candidate", "row_idx")


@check(
    "d12_bootstrap_demos",
    """
with boot as (select candidate, row_idx from (select candidate, row_idx, row_number() over (partition by candidate order by row_idx) as r
    from predictions where score >= 1) t where r <= 4),
f as (select candidate, row_idx, row_number() over (partition by candidate order by row_idx) as r from predictions p
  where not exists (select 1 from boot b where b.candidate = p.candidate and b.row_idx = p.row_idx))
select candidate, row_idx, 'bootstrapped' as source from boot
union all select candidate, row_idx, 'labeled' from f where r <= 16 - (select count(*) from boot b where b.candidate = f.candidate)""",
)
def d12(fx):
    return sel.bootstrap_demos(fx.predictions, fx.predictions, threshold=1.0)


@check(
    "d13_knn_demos",
    """
with s as (select q.vec_id as query_id, t.vec_id as neighbor_id,
    round(list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 6) as similarity
  from embeddings q, embeddings t where q.vec_id <> t.vec_id)
select query_id, neighbor_id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, neighbor_id) as rank from s) u
where rank <= 5""",
)
def d13(fx):
    return nb.knn_demos(fx.embeddings, fx.embeddings, 5, skip_same_id=True)


@check(
    "d13_knn_two_tables",
    """
with q as (select vec_id // 2 as id, embedding from embeddings where vec_id % 2 = 0), t as (select vec_id // 2 as id, embedding from embeddings where vec_id % 2 = 1),
s as (select q.id as query_id, t.id as neighbor_id, round(list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 6) as similarity from q, t)
select query_id, neighbor_id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, neighbor_id) as rank from s) u
where rank <= 3""",
)
def d13_two(fx):
    """Two tables whose ids overlap without meaning the same rows."""
    half = lambda r: fx.embeddings.filter(F.col("vec_id") % 2 == r).select(F.expr("vec_id div 2").alias("vec_id"), "embedding")
    return nb.knn_demos(half(0), half(1), 3)


@check(
    "d13_knn_indexed",
    """
with s as (select q.vec_id as query_id, t.vec_id as neighbor_id,
    round(list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 6) as similarity
  from embeddings q, embeddings t where q.vec_id <> t.vec_id)
select query_id, neighbor_id, similarity, rank, true as recall_reached from (select *, row_number() over (partition by query_id order by similarity desc, neighbor_id) as rank from s) u
where rank <= 5""",
)
def d13_indexed(fx):
    """Through the candidate index; its recall is measured on the queries with ids divisible by 100 against all rows."""
    found = durable(ann.knn_indexed(fx.embeddings, fx.embeddings, 5, skip_same_id=True), "found")
    measured = ann.recall(found, fx.embeddings, fx.embeddings, 5, skip_same_id=True)
    return found.withColumn("recall_reached", F.coalesce(measured.select(F.col("recall") >= 0.9).scalar(), F.lit(True)))


@check(
    "d14_pos_neg",
    """select candidate, row_idx, label from (select *, row_number() over (partition by candidate, label
         order by case when label = 'positive' then -score else score end, row_idx) as r
       from (select *, case when score >= 1 then 'positive' when score <= 0 then 'negative' end as label from predictions) t where label is not null) u where r <= 10""",
)
def d14(fx):
    return sel.pos_neg(fx.predictions, 0.0, 1.0, 10).select("candidate", "row_idx", "label")


@check(
    "d15_holdout",
    """select row_idx, case when ('0x' || substr(md5('7:' || cast(row_idx as varchar)), 1, 13))::bigint / 4503599627370496e0 < 0.1e0 then 'val' else 'train' end as part
       from examples""",
)
def d15(fx):
    return sel.holdout(fx.examples, 0.1, seed=7).select("row_idx", "part")


@check(
    "d16_eval_schedule",
    """
with n as (select count(*) as pool, greatest(cast(floor(count(*) / 35e0) as bigint), 1) as per from examples),
o as (select row_idx, e.epoch, row_number() over (partition by e.epoch order by md5('2:' || cast(e.epoch as varchar) || ':' || cast(row_idx as varchar)), row_idx) as rn
  from examples, (select unnest(range(12)) as epoch) e),
m as (select epoch * per + cast(floor((rn - 1) / 35e0) as bigint) + 1 as trial, row_idx from o, n where rn <= per * 35)
select trial, 'minibatch' as kind, row_idx from m where trial <= 12
union all select t, 'full', row_idx from examples, (select unnest([5, 10])::bigint as t) f""",
)
def d16(fx):
    return sel.eval_schedule(fx.examples, trials=12, size=35, every=5, seed=2)


@check("d17_finetune_export", "select candidate, row_idx, gold, score from predictions where score >= 1")
def d17(fx):
    path = scratch(fx.spark, "finetune")
    sel.finetune_export(fx.predictions, path, multitask=False)
    return fx.spark.read.schema("candidate int, row_idx bigint, gold int, score double").json(path).select(
        "candidate", "row_idx", "gold", "score"
    )


@check(
    "d18_reflective_dataset",
    """
with s as (select *, row_number() over (partition by candidate order by row_idx) as r from predictions where score < 1)
select 'c' || cast(candidate as varchar) as component, 'instruction ' || cast(candidate as varchar) as instruction,
  string_agg(cast(row_idx as varchar) || '/' || cast(pred as varchar) || '/' || coalesce(error, 'wrong'), ',' order by row_idx) as records
from s where r <= 3 group by candidate""",
)
def d18(fx):
    name = F.concat(F.lit("c"), F.col("candidate").cast("string"))
    scored = fx.predictions.select(
        name.alias("component"), "row_idx", "score", F.col("row_idx").cast("string").alias("inputs"),
        F.col("pred").cast("string").alias("outputs"), F.coalesce("error", F.lit("wrong")).alias("feedback"),
    )
    texts = fx.predictions.select(
        name.alias("component"), F.concat(F.lit("instruction "), F.col("candidate").cast("string")).alias("instruction")
    ).distinct()
    out = sel.reflective_dataset(scored, texts, size=3)
    text = F.transform("records", lambda r: F.concat_ws("/", r["inputs"], r["outputs"], r["feedback"]))
    return out.select("component", "instruction", F.array_join(text, ",").alias("records"))
