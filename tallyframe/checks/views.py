"""Run-table shapes as views over the driver tables, in SQL both Spark and DuckDB accept.

Sequence columns use ids or arithmetic instead of ``row_number()``, so building a view
never sorts a whole group in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyframe.session import apply_skew_settings

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "examples": """
select d.doc_id as row_idx, d.source as dataset, d.lang, d.text as input_text, d.n_chars,
  l.quality as gold, l.toxic
from documents d left join labels l on d.doc_id = l.doc_id""",
    # Lists run in descending id order; the test list repeats some rows on purpose.
    "splits": """
select split, ((select max(doc_id) from documents) - doc_id) * 2 + copy as pos, doc_id as row_idx
from (select doc_id, 0 as copy,
        case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'val' else 'test' end as split
      from documents
      union all
      select doc_id, 1 as copy, 'test' as split from documents where doc_id % 50 = 9) t""",
    "bad_splits": """
select split, pos, row_idx from splits
union all select 'holdout', item_id, item_id from benchmark
union all select 'train', 1000000 + item_id, -1 - item_id from benchmark
union all select 'val', 2000000 + item_id, 900000000 + item_id from benchmark
union all select 'val', 3000000 + item_id, item_id * 10 from benchmark""",
    "predictions": """
select c.candidate, l.doc_id as row_idx,
  case when l.doc_id % 10 < 7 then 'train' when l.doc_id % 10 < 9 then 'val' else 'test' end as split,
  l.quality as gold,
  case when d.n_chars > c.threshold then 1 else 0 end as pred,
  case when c.candidate = 1 and l.doc_id % 37 = 0 then 0e0
       when (case when d.n_chars > c.threshold then 1 else 0 end) = l.quality then 1e0 else 0e0 end as score,
  case when c.candidate = 1 and l.doc_id % 37 = 0 then 'timeout' end as error
from labels l join documents d on d.doc_id = l.doc_id
cross join (values (0, 0), (1, 200), (2, 800), (3, 3000)) c(candidate, threshold)""",
    "eval_results": """
select d.lang as run_id, d.doc_id as example_idx, d.doc_id as seq,
  case when d.doc_id % 23 = 0 then 0e0
       when l.quality = (case when d.n_chars > 200 then 1 else 0 end) then 1e0 else 0e0 end as score,
  case when d.doc_id % 23 = 0 then 0e0 else (d.n_chars % 997) / 1000e0 end as latency,
  case when d.doc_id % 23 = 0 then 0e0 else d.n_chars / 1000000e0 end as cost,
  case when d.doc_id % 23 = 0 then 0 else d.n_chars end as tokens_in,
  case when d.doc_id % 23 = 0 then 0 else d.n_chars % 101 end as tokens_out,
  case when d.doc_id % 23 = 0 then 'boom' end as error
from documents d left join labels l on d.doc_id = l.doc_id""",
    "usage_rows": """
select conv_id, model,
  cast(sum(case when role <> 'assistant' then length(text) end) as bigint) as prompt_tokens,
  cast(sum(case when role = 'assistant' then length(text) end) as bigint) as completion_tokens,
  cast(sum(length(text)) as bigint) as total_tokens,
  case when conv_id % 7 = 0 then 0.5e0 when conv_id % 11 = 0 then 0e0 when conv_id % 13 = 0 then -1e0 end as cost
from (select *, case (conv_id + turn) % 5 when 0 then 'acme/small' when 1 then 'acme/large'
                  when 2 then 'hub/acme/small' when 3 then 'hub/broken' else 'nobody/unknown' end as model
      from conversations) t
group by conv_id, model""",
    # 'hub/broken' has no output price, so it must not match.
    "prices": """
select 'acme/small' as model, 0.25e0 as input_per_m, 1.5e0 as output_per_m
union all select 'acme/large', 3e0, 12e0
union all select 'hub/acme/small', 0.2e0, 1.25e0""",
    "calls": """
select user_id as scope, event_id as call_id, 'start' as kind, ts, event_type as name, false as exception
from events where event_id % 17 <> 0
union all
select user_id, event_id, 'end', ts + cast(floor(value) as bigint) * interval '1' second, event_type,
  event_type = 'error'
from events where event_id % 13 <> 0
union all
select user_id, event_id, 'start', ts - interval '5' second, 'replaced', false from events where event_id % 19 = 0
union all
select user_id, event_id, 'end', ts + (1 + cast(floor(value) as bigint)) * interval '1' second, 'repeated', true from events where event_id % 7 = 0
union all
select user_id, event_id, 'start', ts + interval '2' hour, 'again', false from events where event_id % 5 = 0
union all
select user_id, event_id, 'end', ts + interval '3' hour, 'again', false from events where event_id % 5 = 0""",
    "attempts": """
select user_id as example_idx, event_type as pred_name, event_id as attempt,
  md5(cast(event_id as string)) as instruction, least(floor(value / 10e0) / 5e0, 1e0) as score, props as feedback
from events""",
    "jobs": """
select k as id, type,
  case st when 'F' then (case k % 4 when 1 then 'failed' when 2 then 'cancelled' else 'succeeded' end)
          when 'O' then (case when k % 5 = 0 then 'blocked' else 'queued' end) else 'running' end as status,
  'r' || cast(g % 2 as string) as repo_id, 'u' || cast(cust % 200 as string) as user_id,
  'p' || cast(g % 7 as string) as program, 'v0' || cast(g % 3 as string) as version,
  'd' || cast(g % 5 as string) as dataset,
  case when type = 'eval' and k % 2 = 0 then null else 's' || cast(g % 2 as string) end as split,
  case when type = 'eval' then k - 1 end as parent_job_id,
  'base/programs/p' || cast(g % 7 as string) || '/v0' || cast(g % 3 as string) || '/compile.config.'
    || lpad(cast(k % 10000 as string), 4, '0') || '.yaml' as config_path,
  'Repo ' || cast(g % 2 as string) || ' ' || type || '_' || cast(k as string) as run_label_stem,
  1 + k % 3 as attempt,
  case when st = 'P' and k % 23 <> 0 then 'w' || cast(cust % 150 as string) end as worker_id,
  case when st = 'P' and k % 29 <> 0 then created_at + interval '30' second end as lease_expires_at,
  1 + k % 50 as emitted_run_number,
  case when k % 10 = 0 then 0 when k % 4 = 0 then k % 60 end as export_run_number,
  case when k % 31 = 0 then k % 100 else 0 end as seed_max,
  k % 9 = 0 as cancel_requested, k % 6 = 0 as allow_parallel_user_jobs,
  case when k % 8 = 0 then null else k % 2000 end as snapshot_id,
  case k % 4 when 0 then '>=0.1,<0.2' when 1 then '==0.1' when 2 then '>=0.2' else '' end as runtime_spec,
  case when type = 'compile' and k % 2 = 0
    then 'eval.config.d' || cast(g % 5 as string) || '_s' || cast(g % 2 as string) || '-test.yaml' end as auto_eval_path,
  created_at,
  case when st <> 'O' then created_at + interval '5' second end as started_at,
  case when st = 'F' then created_at + (5 + k % 4000) * interval '1' second end as ended_at
from (select o_orderkey as k, cast(floor(o_orderkey / 3e0) as bigint) as g, o_custkey as cust, o_orderstatus as st,
        case when o_orderkey % 3 = 2 then 'eval' else 'compile' end as type,
        o_orderdate + (o_orderkey % 86400) * interval '1' second as created_at
      from orders) t""",
    # The natural key repeats on purpose.
    "artifacts": """
select l_orderkey as job_id, cast(1 + l_linenumber % 3 as bigint) as attempt,
  case l_partkey % 10 when 0 then 'runner/stdout.log' when 1 then 'program.hash' when 2 then 'EVAL_SUMMARY.md'
    when 3 then 'compile.config.yaml' when 4 then 'compiled_program/program.pkl'
    when 5 then 'gepa_logs/state_' || cast(l_linenumber as string) || '.bin'
    when 6 then 'evals/000' || cast(l_linenumber as string) || '/results.jsonl' when 7 then 'evals/0001/metrics.py'
    when 8 then 'compile/program.py' else 'results.jsonl' end as relative_path,
  cast(floor(l_quantity) as bigint) * 1024 as size_bytes, md5(cast(l_partkey as string)) as digest,
  l_shipdate as created_at, md5(cast(l_partkey as string) || '-' || cast(l_suppkey as string)) as tiebreak
from lineitem""",
    "snapshots": """
select p_partkey as snapshot_id, 'r' || cast(p_partkey % 2 as string) as repo_id,
  md5(p_name || cast(p_partkey % 40 as string)) as digest, md5(p_brand) as oob_digest,
  cast(p_size * 1000 as bigint) as size_bytes,
  cast('2001-06-01 00:00:00' as timestamp) + p_partkey * interval '1' hour as created_at
from part""",
    "heartbeats": "select 'w' || cast(user_id as string) as worker_id, ts, event_id from events",
    "job_events": """
select user_id as job_id, event_id as seq, event_type as key,
  cast(cast(floor(value) as bigint) as string) as value from events""",
    "observations": """
select conv_id as trace_id, conv_id * 100 + turn as obs_id,
  case when conv_id % 25 = 0 and turn = 0 then conv_id * 100 + 99
       when turn = 0 then null
       when conv_id % 10 = 3 and turn = 4 then conv_id * 100 + 98
       else conv_id * 100 + cast(floor((turn - 1) / 2e0) as bigint) end as parent_id,
  case role when 'assistant' then 'GENERATION' when 'user' then 'SPAN' else 'EVENT' end as type,
  conv_id * 60 + (turn * 7) % 5 as start_s,
  case when turn % 6 < 5 then conv_id * 60 + (turn * 7) % 5 + (conv_id + turn) % 9 end as end_s,
  case when role = 'assistant' then length(text) * 1e-6 end as total_cost,
  case when (conv_id + turn) % 11 = 0 then 'error' else 'DEFAULT' end as level,
  'acme/' || role as model, cast(length(text) as bigint) as total_tokens
from conversations""",
    "log_lines": """
select job_id, seq, ts,
  case event_type
    when 'view' then '[' || cast(seq as string) || '/9000000] Acc: ' || cast(v % 100 as string) || '.5% | Tokens: 1,'
      || lpad(cast(v % 1000 as string), 3, '0') || ' (in:1,000/out:' || cast(v % 1000 as string) || ') | Cost: $0.'
      || lpad(cast(v % 10000 as string), 4, '0') || ' | Latency: avg=' || cast(v as string) || 'ms, med='
      || cast(v as string) || 'ms' || (case when seq % 3 > 0 then ', var=' || cast(v as string) || 'ms²' else '' end)
      || ' | ETA: ' || cast(seq as string) || 's'
    when 'click' then 'Iteration ' || cast(seq as string) || ': Selected program 0 score: 0.5'
    when 'signup' then (case seq % 3 when 0 then 'Best valset aggregate score so far: 0.' || cast(v % 100 as string)
                          when 1 then 'Valset pareto front aggregate score: 0.' || cast(v % 100 as string)
                          else 'Running GEPA for approx ' || cast(seq as string) || ' metric calls' end)
    when 'purchase' then (case seq % 4 when 0 then 'Iteration ' || cast(seq as string) || ': New program candidate index: 1'
                            when 1 then 'GEPA: ' || cast(v as string) || '/5000 [00:12<01:30, 3.5rollouts/s]'
                            when 2 then 'load: ' || cast(v as string) || '/700 [00:02<?, ?it/s]'
                            else '=== eval start' end)
    else (case when seq % 40 = 1 then '=== done' else 'ERROR worker said ' || cast(v as string) end) end as line
from (select user_id as job_id, event_id as seq, ts, event_type, cast(floor(value) as bigint) as v from events) t""",
    # One in twenty is corrupt.
    "blobs": """
select page_id as blob_id, html as content,
  case when page_id % 20 = 0 then sha256(url) else sha256(html) end as recorded_digest from pages""",
    "paths": """
select page_id as path_id,
  case page_id % 9 when 0 then '/' || p when 1 then 'a/../' || p when 2 then 'base/programs/p1/v01/' || p
    when 3 then 'base/programs/p1/v01/results/0007/' || p
    when 4 then 'base/programs/p2/v02/data/splits/001_002.yaml'
    when 5 then 'media/' || p || '/a b*~é.png' else p end as path,
  page_id % 13 <> 0 as is_regular
from (select page_id, regexp_replace(url, '^https?://', '') as p from pages) t""",
    "manifest_a": "select 'docs/' || cast(doc_id as string) as path, md5(text || cast(doc_id as string)) as digest from documents",
    # 1 in 20 deleted, 1 in 20 modified, 1 in 20 renamed, plus additions.
    "manifest_b": """
select case when doc_id % 20 = 2 then 'moved/' || cast(doc_id as string)
            when doc_id % 20 = 3 then 'docs/' || cast(doc_id as string)
            else 'docs/' || cast(doc_id as string) end as path,
  case when doc_id % 20 = 1 then md5('x' || cast(doc_id as string)) else md5(text || cast(doc_id as string)) end as digest
from documents where doc_id % 20 <> 0
union all select 'base/programs/p1/v01/new/' || cast(item_id as string), md5(text) from benchmark
union all select 'base/programs/p1/v01/results/0001/' || cast(item_id as string), md5(text) from benchmark""",
}


# Where Spark spells something differently (or plans it better) than DuckDB.
_SPARK_SPELLING = [
    (re.compile(r"sha256\((\w+)\)"), r"sha2(\1, 256)"),
    (
        re.compile(r"cross join \(values (.*)\) c\((\w+), (\w+)\)"),
        r"lateral view inline(array(\1)) c as \2, \3",
    ),
]


def spark_sql(name: str) -> str:
    sql = VIEWS[name]
    for pattern, spelling in _SPARK_SPELLING:
        sql = pattern.sub(spelling, sql)
    return sql


def _needed(sql: str) -> list[str]:
    """Views a statement uses, in definition order, including views those views use."""
    used: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in VIEWS.keys() & (words - used):
            used.add(name)
            pending.append(VIEWS[name])
    return [name for name in VIEWS if name in used]


def with_views(sql: str) -> str:
    """DuckDB statement with the views it uses as leading common table expressions."""
    needed = _needed(sql)
    ctes = [f"{name} as ({VIEWS[name]})" for name in needed]
    body = sql.strip()
    if not ctes:
        return body
    lead = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if lead:
        recursive = "recursive " if lead.group(1) else ""
        return f"with {recursive}" + ",\n".join(ctes) + ",\n" + body[lead.end():]
    return "with " + ",\n".join(ctes) + "\n" + body


class Fixtures:
    """Tables and views of one scale-factor folder, read lazily: ``fx.jobs``, ``fx.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = apply_skew_settings(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            words = set(re.findall(r"\w+", VIEWS[name])) - {name}
            for part in [n for n in (*TABLES, *VIEWS) if n in words]:
                getattr(self, part).createOrReplaceTempView(part)
            return self.spark.sql(spark_sql(name))
        raise AttributeError(name)
