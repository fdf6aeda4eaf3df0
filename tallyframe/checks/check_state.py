"""F and J: state resolution, keys and column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.functions import exprs as xp
from tallyframe.operators import state as st
from tallyframe.plans.durable import scratch
from tallyframe.sources import versions


@check(
    "f1_upsert_dims",
    """
with prog as (select source, dense_rank() over (order by source) as program_id from (select distinct source from documents) t),
ver as (select program_id, lang, row_number() over (order by program_id, lang) as version_id
  from (select distinct program_id, lang from documents d join prog p on p.source = d.source) t)
select d.doc_id, p.program_id, v.version_id from documents d join prog p on p.source = d.source
join ver v on v.program_id = p.program_id and v.lang = d.lang""",
)
def f1(fx):
    _dims, facts = st.upsert_dims(fx.documents, [("program", ["source"]), ("version", ["lang"])])
    return facts.select("doc_id", "program_id", "version_id")


@check(
    "f1_upsert_dim_existing",
    """
with old as (select lang, row_number() over (order by lang desc) + 10 as lang_id from (select distinct lang from documents where lang < 'es') t)
select lang, lang_id from old union all
select lang, (select max(lang_id) from old) + row_number() over (order by lang) from (select distinct lang from documents) t where lang not in (select lang from old)""",
)
def f1_existing(fx):
    langs = fx.documents.select("lang").distinct()
    old = st.upsert_dim(None, langs.filter("lang < 'es'").withColumn("k", -F.ascii("lang")), ["k", "lang"], "lang_id")
    old = old.select("lang", (F.col("lang_id") + 10).alias("lang_id"))
    return st.upsert_dim(old, fx.documents, ["lang"], "lang_id")


_KEY = "job_id, attempt, relative_path"


@check(
    "f2_insert_new",
    f"""
with first as (select *, row_number() over (partition by {_KEY} order by created_at, tiebreak, size_bytes) as r,
    row_number() over (partition by {_KEY} order by tiebreak desc, created_at desc, size_bytes desc) as z from artifacts)
select {_KEY}, size_bytes, digest from first where r = 1 and attempt <> 1
union all select {_KEY}, size_bytes, digest from first where z = 1 and attempt = 1""",
)
def f2(fx):
    arts, keys = fx.artifacts, ["job_id", "attempt", "relative_path"]
    target = st.upsert_latest(None, arts.filter("attempt = 1"), keys, ["tiebreak", "created_at", "size_bytes"])
    out = st.insert_new(target.select(*arts.columns), arts, keys, ["created_at", "tiebreak", "size_bytes"])
    return out.select(*keys, "size_bytes", "digest")


@check(
    "f3_upsert_latest",
    """select worker_id, event_id, epoch_us(ts) // 1000000 + 3600 as ts_s from (select *, row_number() over (partition by worker_id order by ts desc, event_id desc) as r from heartbeats) t where r = 1""",
)
def f3(fx):
    hb = fx.heartbeats
    later = hb.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    old = st.upsert_latest(None, hb, ["worker_id"], ["ts", "event_id"])
    out = st.upsert_latest(old.select(*hb.columns), later, ["worker_id"], ["ts", "event_id"])
    return out.select("worker_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_s"))


@check(
    "f2_insert_versioned",
    f"""
with first as (select *, row_number() over (partition by {_KEY} order by ascii(tiebreak) % 2, created_at, tiebreak, size_bytes, digest) as r from artifacts)
select {_KEY}, size_bytes, digest from first where r = 1""",
)
def f2_versioned(fx):
    """Half of the rows, then all of them, both sent again; what no record names stays unread."""
    arts, keys, root = fx.artifacts, ["job_id", "attempt", "relative_path"], scratch(fx.spark, "versions")
    for i in (0, 1, 1, 0):
        part = arts.filter(F.ascii("tiebreak") % 2 <= i)
        versions.apply_batch(part, root, keys, ["created_at", "tiebreak", "size_bytes"], keep="first", writer="load", batch_id=i)
    arts.limit(0).withColumn(versions.BUCKET, F.lit(0)).write.partitionBy(versions.BUCKET).parquet(f"{root}/data/killed")
    return versions.read_version(fx.spark, root).select(*keys, "size_bytes", "digest")


@check(
    "f4_fence",
    """select a.job_id, a.attempt, a.relative_path, a.tiebreak, a.size_bytes from artifacts a
       where exists (select 1 from jobs j where j.id = a.job_id and j.attempt = a.attempt and j.worker_id = 'w' || cast(a.job_id % 1500 % 150 as varchar))""",
)
def f4(fx):
    writes = fx.artifacts.withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 1500 % 150).cast("string")))
    return st.fence(writes, fx.jobs).select("job_id", "attempt", "relative_path", "tiebreak", "size_bytes")


_STATUS_EVENTS = """ev as (select user_id as job_id, event_id as seq, ts, 'w' || cast(event_id % 9 as varchar) as worker_id,
  case event_type when 'view' then 'running' when 'click' then 'queued' when 'signup' then 'succeeded' when 'purchase' then 'running' else 'failed' end as status from events)"""


@check(
    "f5_apply_transitions",
    f"""
with {_STATUS_EVENTS},
f as (select job_id, arg_max(status, seq) as st, arg_max(worker_id, seq) as wk, arg_min(ts, seq) filter (status = 'running') as s,
    arg_max(ts, seq) filter (status in ('succeeded','failed','cancelled')) as e, count(*) filter (status = 'running') as claims from ev group by job_id)
select j.id, coalesce(f.st, j.status) as status, case when f.st is null then j.worker_id when f.st = 'running' then f.wk end as worker_id,
  epoch_us(coalesce(j.started_at, f.s)) as started_us,
  epoch_us(case when f.st is null then j.ended_at when f.st in ('succeeded','failed','cancelled') then f.e end) as ended_us,
  j.attempt + coalesce(f.claims, 0) as attempt
from jobs j left join f on f.job_id = j.id""",
)
def f5(fx):
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("view", "purchase"), "running").when(kind == "click", "queued").when(kind == "signup", "succeeded").otherwise("failed")
    )
    ev = fx.events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("w"), (F.col("event_id") % 9).cast("string")).alias("worker_id"), status.alias("status"),
    )
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = st.apply_transitions(fx.jobs, ev)
    return out.select("id", "status", "worker_id", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"), "attempt")


@check(
    "f6_allocate",
    """
with r as (select *, row_number() over (partition by repo_id, program, version order by id) as rn from jobs where type = 'compile')
select id, program, rn + max(seed_max + 1 - rn) over (partition by repo_id, program, version order by id rows between unbounded preceding and current row) as run_number from r""",
)
def f6(fx):
    out = st.allocate(fx.jobs.filter("type = 'compile'"), ["repo_id", "program", "version"])
    return out.select("id", "program", "run_number")


@check(
    "f6_allocate_evals",
    """
with r as (select *, row_number() over (partition by parent_job_id order by id) as rn from (select id, id % 1000 as parent_job_id, seed_max from jobs where type = 'eval') t)
select id, parent_job_id, rn + max(seed_max + 1 - rn) over (partition by parent_job_id order by id rows between unbounded preceding and current row) as run_number from r""",
)
def f6_evals(fx):
    """Eval numbers count per compile; many evals share one here."""
    evals = fx.jobs.filter("type = 'eval'").select("id", (F.col("id") % 1000).alias("parent_job_id"), "seed_max")
    return st.allocate(evals, ["parent_job_id"]).select("id", "parent_job_id", "run_number")


@check(
    "f7_bump",
    """
with c as (select program, version, count(*) as next_number from jobs where program <> 'p0' group by program, version),
i as (select program, version, max(emitted_run_number) + 1 as seen from jobs where program <> 'p1' group by program, version)
select coalesce(c.program, i.program) as program, coalesce(c.version, i.version) as version, greatest(next_number, seen) as next_number
from c full outer join i on c.program = i.program and c.version = i.version""",
)
def f7(fx):
    counters = fx.jobs.filter("program <> 'p0'").groupBy("program", "version").agg(F.count(F.lit(1)).alias("next_number"))
    return st.bump(counters, fx.jobs.filter("program <> 'p1'"), ["program", "version"])


@check(
    "f8_merge_summaries",
    """
with m as (select job_id, key, arg_max(value, seq) as value from (
    select job_id, seq, key, value from job_events union all select job_id, seq, 'last', '"' || key || '"' from job_events) t group by job_id, key)
select job_id, string_agg(key || '=' || value, ';' order by key) as summary from m group by job_id""",
)
def f8(fx):
    je = fx.job_events
    patch = F.concat(F.lit('{"'), F.col("key"), F.lit('":'), F.col("value"), F.lit(',"last":"'), F.col("key"), F.lit('"}'))
    merged = st.merge_summaries(st.explode_patches(je.withColumn("patch", patch), "patch"))
    text = F.transform(F.array_sort(F.map_entries("summary")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("job_id", F.array_join(text, ";").alias("summary"))


@check(
    "f10_run_label",
    """select id, left(trim(regexp_replace(lower(run_label_stem || ' (Ünit)/' || config_path), '[^a-z0-9_-]+', '-', 'g'), '-_'), 33) || '_'
         || left(sha1(run_label_stem || ' (Ünit)/' || config_path), 6) as run_label from jobs""",
)
def f10(fx):
    return fx.jobs.select("id", st.run_label(F.concat("run_label_stem", F.lit(" (Ünit)/"), "config_path")).alias("run_label"))


@check(
    "f11_infer_keys",
    r"""select path_id, nullif(regexp_extract(path, '(?:base/programs|programs)/([^/]+)/([^/]+)/', 1), '') as program,
        nullif(regexp_extract(path, '(?:base/programs|programs)/([^/]+)/([^/]+)/', 2), '') as version,
        nullif(regexp_extract(path, 'data/splits/(\d+)_(\d+)\.ya?ml$', 1), '') as dataset,
        nullif(regexp_extract(path, 'data/splits/(\d+)_(\d+)\.ya?ml$', 2), '') as split,
        try_cast(nullif(regexp_extract(path, '(?:base/programs|programs)/[^/]+/[^/]+/results/(\d{4})(?:/|$)', 1), '') as bigint) as results_number from paths""",
)
def f11(fx):
    out = st.infer_keys(fx.paths, "path", ["programs"])
    return out.select("path_id", "program", "version", "dataset", "split", "results_number")


# ---------------------------------------------------------------- column helpers


@check(
    "j1_to_count",
    """select job_id, seq, try_cast(replace(nullif(regexp_extract(line, 'Tokens:\\s*([\\d,]+)', 1), ''), ',', '') as bigint) as tokens from log_lines""".replace("\\\\", "\\"),
)
def j1(fx):
    raw = F.regexp_extract("line", r"Tokens:\s*([\d,]+)", 1)
    return fx.log_lines.select("job_id", "seq", xp.to_count(raw).alias("tokens"))


@check(
    "j2_pct",
    """select doc_id, case when c <> 0 and t <> 0 then round(100e0 * c / t, 1) end as rollouts, case when t = 0 then 0e0 else round(100e0 * c / t, 1) end as rows_pct
       from (select doc_id, n_chars % 7 as c, doc_id % 8 as t from documents) x""",
)
def j2(fx):
    x = fx.documents.select("doc_id", (F.col("n_chars") % 7).alias("c"), (F.col("doc_id") % 8).alias("t"))
    return x.select("doc_id", xp.pct("c", "t").alias("rollouts"), xp.pct("c", "t", "rows").alias("rows_pct"))


@check(
    "j3_pick_identity",
    """select path_id, coalesce(left(nullif(trim(case when path_id % 3 = 0 then '  ' when path_id % 5 = 0 then path || repeat('x', 300) end), ''), 256),
         left(nullif(trim(case when path_id % 2 = 0 then '  u' || cast(path_id as varchar) || ' ' end), ''), 256), 'anonymous') as who from paths""",
)
def j3(fx):
    i = F.col("path_id")
    first = F.when(i % 3 == 0, "  ").when(i % 5 == 0, F.concat("path", F.repeat(F.lit("x"), 300)))
    second = F.when(i % 2 == 0, F.concat(F.lit("  u"), i.cast("string"), F.lit(" ")))
    return fx.paths.select("path_id", xp.pick_identity(first, second).alias("who"))


@check("j4_run_no", "select id, case when id > 9999 then cast(id as varchar) else lpad(cast(id as varchar), 4, '0') end as run_no from jobs")
def j4(fx):
    return fx.jobs.select("id", xp.run_no("id").alias("run_no"))


@check(
    "j5_base_stem",
    r"""select id, regexp_replace(regexp_extract(config_path, '[^/]*$'), '\.[^.]*$', '') as stem, substr(config_path, 6) as inner_path, program as same from jobs""",
)
def j5(fx):
    return fx.jobs.select(
        "id", xp.base_stem("config_path").alias("stem"), xp.strip_base("config_path", "base").alias("inner_path"),
        xp.strip_base("program", "base").alias("same"),
    )


@check(
    "j6_media_url",
    "select path_id, 'https://m.example/x/' || replace(url_encode(path), '%2F', '/') as media_url from paths",
)
def j6(fx):
    return fx.paths.select("path_id", xp.media_url("path", "https://m.example/x/").alias("media_url"))


@check(
    "j7_compatible",
    "select id, runtime_spec, runtime_spec <> '>=0.2' and runtime_spec <> '==0.1' as ok from jobs",
)
def j7(fx):
    return fx.jobs.select(
        "id", "runtime_spec", xp.compatible("runtime_spec", "0.1.5").alias("ok")
    )
