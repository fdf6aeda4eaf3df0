"""G: artifact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.operators import artifacts as ar

_KIND = """case when relative_path like 'runner/%' then case when relative_path like '%stdout.log' then 'stdout_log' else 'other' end
  when relative_path = 'program.hash' then 'program_hash' when relative_path = 'EVAL_SUMMARY.md' then 'eval_summary_md'
  when relative_path like '%.yaml' and relative_path not like '%/%' then 'config'
  when relative_path like 'compiled\\_program/program.pkl%' escape '\\' then 'compiled_program'
  when relative_path like 'gepa\\_logs/%' escape '\\' then 'gepa_log' when relative_path like '%/results.jsonl' then 'results_jsonl'
  when relative_path like '%/metrics.py' then 'metrics_py' when relative_path like '%/program.py' then 'program_py' else 'other' end"""
_COLS = ["job_id", "attempt", "relative_path", "size_bytes", "digest", "tiebreak"]


def _kinds(fx):
    return fx.artifacts.withColumn("kind", ar.classify("relative_path"))


@check(
    "g1_artifacts_for",
    f"""select a.{', a.'.join(_COLS)} from artifacts a join jobs j on j.id = a.job_id and j.attempt = a.attempt
        where {_KIND} = 'results_jsonl' and relative_path like 'evals/%'""",
)
def g1(fx):
    return ar.artifacts_for(fx.jobs, _kinds(fx), "results_jsonl", "evals/").select(*_COLS)


@check(
    "g2_classify",
    f"""select relative_path, {_KIND} as kind, case when relative_path = 'program.hash' then 'program_hash'
          when relative_path like '%.yaml' and relative_path not like '%/%' then 'config'
          when relative_path like 'compiled\\_program/program.pkl%' escape '\\' then 'compiled_program'
          when relative_path like 'gepa\\_logs/%' escape '\\' then 'gepa_log' when relative_path like 'compile/program.py%' then 'program_py' else 'other' end as import_kind,
        count(*) as files from artifacts group by 1, 2, 3""",
)
def g2(fx):
    tagged = _kinds(fx).withColumn("import_kind", ar.classify("relative_path", "import"))
    return tagged.groupBy("relative_path", "kind", "import_kind").agg(F.count(F.lit(1)).alias("files"))


@check(
    "g3_include",
    f"select {', '.join(_COLS)} from artifacts where relative_path like 'compile/%' or relative_path like 'gepa\\_logs/%' escape '\\' or relative_path = 'program.hash'",
)
def g3(fx):
    return ar.include(fx.artifacts, ["compile/", "gepa_logs/"], ["program.hash"]).select(*_COLS)


@check(
    "g4_parent_plan",
    """select e.id as eval_id, a.job_id, a.relative_path, a.tiebreak, a.size_bytes, a.digest from jobs e join jobs p on p.id = e.parent_job_id
       join artifacts a on a.job_id = p.id and a.attempt = p.attempt where e.type = 'eval' and a.relative_path not like 'runner/%'""",
)
def g4(fx):
    return ar.parent_plan(fx.jobs, fx.artifacts).select("eval_id", "job_id", "relative_path", "tiebreak", "size_bytes", "digest")


@check(
    "g5_export_plan",
    """
with home as (select id, 'out/' || program || '/' || version || '/results/' || lpad(cast(coalesce(nullif(export_run_number, 0), emitted_run_number) as varchar), 4, '0') as folder
  from jobs where type = 'compile'),
plan as (select id, id as home_id, id as job_id from jobs where type = 'compile' union all select id, parent_job_id, id from jobs where type = 'eval'
  union all select id, parent_job_id, parent_job_id from jobs where type = 'eval')
select plan.id, a.job_id, a.tiebreak, a.size_bytes, home.folder || '/' || a.relative_path as destination
from plan join home on home.id = plan.home_id join jobs j on j.id = plan.job_id
join artifacts a on a.job_id = plan.job_id and a.attempt = j.attempt where a.relative_path not like 'runner/%'""",
)
def g5(fx):
    return ar.export_plan(fx.jobs, fx.artifacts, "out").select("id", "job_id", "tiebreak", "size_bytes", "destination")


@check(
    "g6_audit_paths",
    """select path_id, path, case when not is_regular then 'not a regular file' when path like '/%' then 'absolute path'
       when list_contains(string_split(path, '/'), '..') then 'parent segment' when path not like 'base/programs/%' then 'outside roots'
       when string_split(path, '/')[5] = 'results' then 'results path' end as reason from paths""",
)
def g6(fx):
    return ar.audit_paths(fx.paths, ["base/programs"]).select("path_id", "path", "reason")


@check(
    "g7_artifact_stats",
    f"select job_id, kind, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from (select job_id, size_bytes, {_KIND} as kind from artifacts) t group by rollup (job_id, kind)",
)
def g7(fx):
    return ar.artifact_stats(_kinds(fx))


@check(
    "g8_diff_manifests",
    """
with f as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted'
    when a.digest <> b.digest then 'modified' else 'unchanged' end as status, coalesce(a.digest, b.digest) as d
  from manifest_a a full outer join manifest_b b on a.path = b.path),
n as (select *, row_number() over (partition by status, d order by md5(path), path) as k from f where status in ('added', 'deleted')),
p as (select coalesce(y.path, x.path) as path, case when y.path is null then 'deleted' when x.path is null then 'added' else 'renamed' end as status,
    case when y.path is not null then x.path end as old_path
  from (select * from n where status = 'deleted') x full outer join (select * from n where status = 'added') y on x.d = y.d and x.k = y.k),
s as (select path, status, null as old_path from f where status in ('modified', 'unchanged') union all select * from p)
select path, status, old_path, case when status = 'unchanged' then 'none' when path like 'base/programs/%/%/results/%' then 'ignored'
  when path not like 'base/programs/%' then 'rejected: outside overlay roots'
  when status in ('deleted', 'renamed') then 'rejected: deletion or rename' else 'included' end as verdict from s""",
)
def g8(fx):
    return ar.diff_manifests(fx.manifest_a, fx.manifest_b, ["base/programs"])


@check(
    "g9_merge_layers",
    """select path, layer, size_bytes from (select *, row_number() over (partition by path order by layer) as r from (
         select cast(job_id % 5000 as varchar) || '/' || relative_path as path, max(size_bytes) as size_bytes, attempt as layer from artifacts group by 1, 3) t) u where r = 1""",
)
def g9(fx):
    layers = fx.artifacts.groupBy(
        F.concat_ws("/", (F.col("job_id") % 5000).cast("string"), "relative_path").alias("path"), F.col("attempt").alias("layer")
    ).agg(F.max("size_bytes").alias("size_bytes"))
    return ar.merge_layers(layers)
