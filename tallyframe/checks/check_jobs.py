"""E: job table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.operators import jobs as jb

NOW = "2001-08-02 00:00:00"


def _dims(fx):
    """Surrogate-keyed dimensions derived from the jobs, and the jobs with ids instead of names."""
    jobs, dims = fx.jobs, {}
    for name in ("program", "version", "dataset", "split"):
        ids = jobs.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("id").alias(f"{name}_id"))
        dims[name] = ids.filter(F.col(name) != "p6")  # one name is missing on purpose
        jobs = jobs.join(ids, name, "left").drop(name)
    return jobs, dims


@check(
    "e1_list_jobs",
    """select id, program, status from jobs where program = 'p3' and status = 'succeeded' order by created_at desc, id desc limit 100""",
)
def e1(fx):
    jobs, dims = _dims(fx)
    out = jb.list_jobs(jobs, dims, program="p3", status="succeeded")
    return jb.job_view(out, {"program": dims["program"]}).select("id", "program", "status")


@check(
    "e2_job_view",
    "select id, nullif(program, 'p6') as program, version, dataset, split from jobs",
)
def e2(fx):
    jobs, dims = _dims(fx)
    return jb.job_view(jobs, dims).select("id", "program", "version", "dataset", "split")


@check(
    "e3_lineage",
    """
with c as (select parent_job_id, count(*) as children, max(id) as latest_child from jobs where parent_job_id is not null group by parent_job_id)
select j.id, j.type, j.status, j.parent_job_id, p.type as parent_type, p.status as parent_status, coalesce(c.children, 0) as children, c.latest_child
from jobs j left join jobs p on p.id = j.parent_job_id left join c on c.parent_job_id = j.id""",
)
def e3(fx):
    return jb.lineage(fx.jobs)


@check("e3_children", "select p.id, p.type, c.id as child_id, c.status as child_status from jobs p join jobs c on c.parent_job_id = p.id")
def e3_children(fx):
    return jb.children_of(fx.jobs)


_REQUESTS = """req as (select id + 1000000 as request_id, case when id % 7 = 0 then -id else id - 1 end as parent_job_id,
  case when id % 3 = 0 then dataset end as dataset, case when id % 4 = 0 then split end as split,
  case when id % 5 = 0 then snapshot_id end as snapshot_id from jobs)"""


def _requests(fx):
    i = F.col("id")
    return fx.jobs.select(
        (i + 1000000).alias("request_id"),
        F.when(i % 7 == 0, -i).otherwise(i - 1).alias("parent_job_id"),
        *[F.when(i % n == 0, F.col(c)).alias(c) for c, n in (("dataset", 3), ("split", 4), ("snapshot_id", 5))],
    )


@check(
    "e4_admit_evals",
    f"""with {_REQUESTS}
select r.request_id, r.parent_job_id, case when p.id is null or p.type <> 'compile' then 404 when p.status <> 'succeeded' then 409 else 202 end as code,
  case when p.id is null then 'parent not found' when p.type <> 'compile' then 'parent is not a compile job'
       when p.status <> 'succeeded' then 'parent has not succeeded' end as reason
from req r left join jobs p on p.id = r.parent_job_id""",
)
def e4(fx):
    return jb.admit_evals(_requests(fx), fx.jobs).select("request_id", "parent_job_id", "code", "reason")


@check(
    "e5_inherit",
    f"""with {_REQUESTS}
select r.request_id, coalesce(r.dataset, p.dataset) as dataset, coalesce(r.split, p.split) as split, coalesce(r.snapshot_id, p.snapshot_id) as snapshot_id,
  case when r.request_id % 2 = 0 then 'own' else b.config_path end as bundle
from req r left join jobs p on p.id = r.parent_job_id
left join jobs b on b.id = case when r.request_id % 3 <> 0 then r.parent_job_id end""",
)
def e5(fx):
    req = _requests(fx).withColumns(
        {
            "config_path": F.when(F.col("request_id") % 2 == 0, "own"),
            "inherit_bundle_from": F.when(F.col("request_id") % 3 != 0, F.col("parent_job_id")),
        }
    )
    out = jb.inherit(req, fx.jobs, ["dataset", "split", "snapshot_id"], bundle="config_path")
    return out.select("request_id", "dataset", "split", "snapshot_id", F.col("config_path").alias("bundle"))


@check(
    "e6_chain_evals",
    """select id as parent_job_id, program, coalesce(auto_eval_path, 'eval.config.' || dataset || '_' || split || '-test.yaml') as config_name
       from jobs where type = 'compile' and status = 'succeeded' and (auto_eval_path is not null or (program in ('p1', 'p2') and dataset <> 'd4'))""",
)
def e6(fx):
    names = fx.jobs.filter("program in ('p1', 'p2') and dataset <> 'd4' and split is not null")
    files = names.select("program", "version", jb.default_auto_eval(F.col("dataset"), F.col("split")).alias("name"))
    return jb.chain_evals(fx.jobs, files).select("parent_job_id", "program", "config_name")


_TIMED = f"""t as (select *, cast(case when started_at is not null then greatest(0, round(
    (epoch_us(coalesce(ended_at, timestamp '{NOW}')) - epoch_us(started_at)) / 1e6)) end as bigint) as run_s,
  cast((epoch_us(started_at) - epoch_us(created_at)) / 1e6 as bigint) as wait_s from jobs)"""


@check(
    "e7_durations",
    f"""with {_TIMED} select id, wait_s, run_s, case when run_s is null then '-' when run_s < 60 then cast(run_s as varchar) || 's'
        else cast(run_s // 60 as varchar) || 'm' || cast(run_s % 60 as varchar) || 's' end as run_text from t""",
)
def e7(fx):
    return jb.durations(fx.jobs, NOW).select("id", "wait_s", "run_s", "run_text")


@check(
    "e7_duration_percentiles",
    f"""with {_TIMED} select program, count(run_s) as jobs, round(quantile_cont(run_s, 0.5), 4) as p50, round(quantile_cont(run_s, 0.9), 4) as p90,
        round(quantile_cont(run_s, 0.99), 4) as p99, max(run_s) as max_s from t group by program""",
)
def e7_percentiles(fx):
    out = jb.duration_percentiles(jb.durations(fx.jobs, NOW), ["program"])
    return out.withColumns({c: F.round(c, 4) for c in ("p50", "p90", "p99")})


@check(
    "e8_summary_metrics",
    """select id, case when id % 5 <> 0 then id % 100 / 2e0 end as acc_pct, case when id % 7 <> 0 then id % 50 / 4e0 end as cost_usd,
       id % 1000 as rows, 'eval' as phase, id % 10 * 10e0 as rows_pct, null::double as rollouts_pct,
       case when id % 3 = 0 then 50e0 else id % 90 + 2e0 end as best_pct, null::double as front_pct from jobs where id % 11 <> 0
       union all select id, null, null, null, null, null, null, null, null from jobs where id % 11 = 0""",
)
def e8(fx):
    i = F.col("id")
    num = lambda c: c.cast("string")
    doc = F.concat(
        F.lit('{"rows":'), num(i % 1000), F.lit(',"phase":"eval","acc_pct":'), F.when(i % 5 != 0, num(i % 100 / 2)).otherwise('"n/a"'),
        F.when(i % 7 != 0, F.concat(F.lit(',"cost_usd":'), num(i % 50 / 4))).otherwise(""),
        F.lit(',"eval":{"rowsPct":'), num(i % 10 * 10.0), F.lit('},"compile":{"bestValset":'),
        F.when(i % 3 == 0, "0.5").otherwise(num(i % 90 + 2.0)), F.lit(',"rolloutsPct":null}}'),
    )
    rows = fx.jobs.select("id", F.when(i % 11 != 0, doc).otherwise("not json").alias("summary"))
    return jb.summary_metrics(rows).drop("summary")


@check(
    "e9_status_counts",
    "select type, user_id, program, count(*) as jobs, "
    + ", ".join(f"count(case when status = '{s}' then 1 end) as {s}" for s in jb.STATUSES)
    + " from jobs group by type, user_id, program",
)
def e9(fx):
    return jb.status_counts(fx.jobs)


_WAIT = """q as (select j.*, case when cancel_requested then 'cancel requested' when snapshot_id is null then 'no snapshot'
    when not allow_parallel_user_jobs and exists (select 1 from jobs r where r.status = 'running' and r.user_id = j.user_id) then 'user has a running job' end as reason
  from jobs j where status = 'queued')"""


@check(
    "e10_backlog",
    f"""with {_WAIT} select id, user_id, epoch_us(created_at) // 1000000 as created_s, reason, reason is null as runnable,
        row_number() over (partition by user_id order by created_at, id) as position from q""",
)
def e10(fx):
    out = jb.backlog(fx.jobs)
    return out.select("id", "user_id", F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created_s"), "reason", "runnable", "position")


@check(
    "e11_next_per_user",
    """
with u as (select *, user_id || '-' || cast(id % 97 as varchar) as usr from jobs),
q as (select * from u where status = 'queued' and not cancel_requested and snapshot_id is not null and not allow_parallel_user_jobs
  and usr not in (select usr from u where status = 'running'))
select usr as user_id, id from (select *, row_number() over (partition by usr order by created_at, id) as r from q) t where r = 1""",
)
def e11(fx):
    spread = fx.jobs.withColumn("user_id", F.concat("user_id", F.lit("-"), (F.col("id") % 97).cast("string")))
    return jb.next_per_user(spread).select("user_id", "id")


@check(
    "e12_serial_violations",
    "select user_id, count(*) as running from jobs where status = 'running' and not allow_parallel_user_jobs group by user_id having count(*) > 1",
)
def e12(fx):
    return jb.serial_violations(fx.jobs)


@check(
    "e13_audit_jobs",
    """
with j as (select *, case when id % 50 = 2 then null else parent_job_id end as par from jobs)
select 'parent iff eval' as rule, cast(id as varchar) as scope, 1::bigint as n from j where (type = 'eval') <> (par is not null)
union all select 'compile number', concat_ws('/', repo_id, program, version, emitted_run_number), count(*) from j where type = 'compile' group by 2 having count(*) > 1
union all select 'eval number', concat_ws('/', par, emitted_run_number), count(*) from j where type = 'eval' group by 2 having count(*) > 1
union all select 'compile export number', concat_ws('/', repo_id, program, version, export_run_number), count(*) from j
  where type = 'compile' and export_run_number is not null group by 2 having count(*) > 1
union all select 'eval export number', concat_ws('/', par, export_run_number), count(*) from j
  where type = 'eval' and export_run_number is not null group by 2 having count(*) > 1
union all select 'label', run_label_stem, count(*) from j group by 2 having count(*) > 1""",
)
def e13(fx):
    rows = fx.jobs.withColumn("parent_job_id", F.when(F.col("id") % 50 != 2, F.col("parent_job_id")))
    return jb.audit_jobs(rows, label="run_label_stem")


@check(
    "e14_latest_succeeded",
    """
with c as (select * from jobs where type = 'compile'),
w as (select *, row_number() over (partition by repo_id, program, version order by created_at desc, id desc) as r from c where status = 'succeeded')
select g.repo_id, g.program, g.version, w.id as latest_id, g.next_number
from (select repo_id, program, version, max(emitted_run_number) + 1 as next_number from c group by all) g
left join w on w.repo_id = g.repo_id and w.program = g.program and w.version = g.version and w.r = 1""",
)
def e14(fx):
    return jb.latest_succeeded(fx.jobs).drop("latest_at")
