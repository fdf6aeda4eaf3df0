"""H and I: content addressing, retention, liveness, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.operators import storage as so, traces as tr
from tallyframe.plans.durable import scratch
from tallyframe.sources import blobs

NOW = "2001-08-02 00:00:00"
_DROP = f"""m as (select *, snapshot_id not in (select snapshot_id from jobs where snapshot_id is not null) and created_at < timestamp '{NOW}' - interval 24 hour as gone from snapshots)"""


def _snaps(fx):
    """Twice the snapshots: the job view refers to ids below 2000 only."""
    s = fx.snapshots
    return s.unionByName(s.withColumns({"snapshot_id": F.col("snapshot_id") + 100000, "created_at": F.col("created_at") - F.expr("interval 30 days")}))


_SNAPS = """snaps as (select * from snapshots union all select snapshot_id + 100000, repo_id, digest, oob_digest, size_bytes, created_at - interval 30 day from snapshots)"""


@check(
    "h1_retention_plan",
    f"""with {_SNAPS}, {_DROP.replace('from snapshots)', 'from snaps)')}
select 'manifest' as kind, cast(snapshot_id as varchar) as key from m where gone
union all select 'snapshot_blob', digest from m group by digest having bool_and(gone)
union all select 'oob_blob', oob_digest from m group by oob_digest having bool_and(gone)""",
)
def h1(fx):
    return so.retention_plan(_snaps(fx), fx.jobs, NOW)


@check(
    "h2_orphans",
    f"""select 'bundles/' || cast(page_id * 97 as varchar) as name from pages where page_id * 97 not in (select id from jobs)
        and (page_id % 5 = 0 or timestamp '2001-07-30' + page_id * interval 1 hour < timestamp '{NOW}' - interval 24 hour)""",
)
def h2(fx):
    name = lambda c: F.concat(F.lit("bundles/"), c.cast("string"))
    modified = F.expr("timestamp '2001-07-30 00:00:00' + page_id * interval '1' hour")
    objects = fx.pages.select(name(F.col("page_id") * 97).alias("name"), F.when(F.col("page_id") % 5 != 0, modified).alias("modified_at"))
    return so.orphans(objects, fx.jobs.select(name(F.col("id")).alias("name")), NOW).select("name")


# Heartbeats are sparse, so a worker counts as live for a day here.
_LIVE = "live as (select worker_id from heartbeats group by worker_id having max(ts) > (select max(ts) from heartbeats) - interval 6 hour)"


def _latest(fx):
    return fx.events.agg(F.max("ts").cast("string")).first()[0]


@check(
    "h3_reclaim_plan",
    f"""with {_LIVE}
select id, worker_id, case when cancel_requested then 'cancelled' else 'queued' end as new_status from jobs
where status = 'running' and (lease_expires_at < (select max(ts) from heartbeats) or worker_id not in (select worker_id from live))""",
)
def h3(fx):
    return so.reclaim_plan(fx.jobs, fx.heartbeats, _latest(fx), seconds=6 * 3600)


@check("h4_stale_queue", f"""select id, 'failed' as new_status, 'queued_without_snapshot' as error from jobs
  where status = 'queued' and snapshot_id is null and created_at < timestamp '{NOW}' - interval 5 minute""")
def h4(fx):
    return so.stale_queue(fx.jobs, NOW)


_AVAILABLE = "av as (select digest from snapshots where repo_id = 'r0')"


@check(
    "h5_block_plan",
    f"""with {_AVAILABLE}
select * from (select j.id, j.snapshot_id, case when j.snapshot_id is null then 'job has no snapshot' when s.digest is null then 'snapshot has no digest'
    when s.digest not in (select digest from av) then 'snapshot unavailable' when j.runtime_spec in ('>=0.2', '==0.1') then 'runtime incompatible' end as reason
  from jobs j left join snapshots s on s.snapshot_id = j.snapshot_id where j.status = 'running') t where reason is not null""",
)
def h5(fx):
    available = fx.snapshots.filter("repo_id = 'r0'").select("digest")
    return so.block_plan(fx.jobs, fx.snapshots, available, "0.1.5")


@check(
    "h5_unblock_plan",
    f"""with {_AVAILABLE} select id, 'queued' as new_status from jobs where status = 'blocked' and snapshot_id in (
        select snapshot_id from snapshots where digest in (select digest from av))""",
)
def h5_unblock(fx):
    return so.unblock_plan(fx.jobs, fx.snapshots, fx.snapshots.filter("repo_id = 'r0'").select("digest"))


@check("h6_verify_digests", "select blob_id, sha256(content) as computed_digest, sha256(content) = recorded_digest as intact from blobs")
def h6(fx):
    return so.verify_digests(fx.blobs).select("blob_id", "computed_digest", "intact")


@check(
    "h6_verify_files",
    """
with b as (select doc_id // 32 as block, sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as digest,
  cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as size_bytes from documents group by 1)
select cast(block as bigint) as block, size_bytes, digest as computed_digest,
  case when block % 5 = 2 then 'unrecorded' when block % 7 = 3 then 'changed' else 'intact' end as status from b
union all select cast(block as bigint), null, null, 'missing' from b where block % 5 = 1""",
)
def h6_files(fx):
    """Documents as one file per 32 ids; some records altered, dropped, or of files that are gone."""
    root = scratch(fx.spark, "blobs")
    docs = fx.documents.select((F.floor(F.col("doc_id") / 32)).alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "text").write.partitionBy("block").text(root)
    block = lambda c: F.regexp_extract(c, r"block=(\d+)", 1).cast("bigint")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    digests = docs.groupBy("block").agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")).cast("binary"), 256).alias("d"))
    files = blobs.list_objects(fx.spark, root).withColumn("block", block("name"))
    altered = F.when(F.col("block") % 7 == 3, F.reverse("d")).otherwise(F.col("d")).alias("recorded_digest")
    records = files.join(digests, "block").filter("block % 5 <> 2").select("name", altered, "size_bytes")
    gone = digests.filter("block % 5 = 1").select(F.concat(F.lit("gone/block="), "block").alias("name"), F.col("d").alias("recorded_digest"), F.lit(1).alias("size_bytes"))
    out = so.verify_files(records.unionByName(gone), blobs.digest_objects(fx.spark, root))
    return out.select(block("name").alias("block"), "size_bytes", "computed_digest", "status")


def _fold(level: str, src: str, digits: int) -> str:
    return f"""{level} as (select left(prefix, {digits}) as prefix, left(prefix, {digits}) || ':' || sha256(string_agg(entry, ',' order by entry)) as entry
  from {src} group by left(prefix, {digits}))"""


@check(
    "h7_dataset_digest",
    f"""
with r as (select sha256(concat_ws('|', doc_id, sha256(text), coalesce(sha256(lang), 'null'))) as prefix, count(*) as n from documents group by 1),
l as (select prefix, prefix || ':' || cast(n as varchar) as entry from r),
{_fold('l6', 'l', 6)}, {_fold('l4', 'l6', 4)}, {_fold('l2', 'l4', 2)}, {_fold('l0', 'l2', 0)}
select substr(entry, 2) as digest from l0""",
)
def h7(fx):
    return so.dataset_digest(fx.documents, "doc_id", ["text", "lang"])


@check(
    "h8_dedupe_stats",
    f"""with {_SNAPS} select repo_id, count(*) as manifests, count(distinct digest) as contents, cast(sum(size_bytes) as bigint) as bytes,
        cast(sum(size_bytes) - (select sum(m) from (select max(size_bytes) as m from snaps i where i.repo_id = o.repo_id group by digest) t) as bigint) as bytes_saved,
        round(count(*) / count(distinct digest), 6) as dedupe_ratio from snaps o group by repo_id""",
)
def h8(fx):
    return so.dedupe_stats(_snaps(fx), ["repo_id"]).withColumn("dedupe_ratio", F.round("dedupe_ratio", 6))


@check(
    "h9_resolve",
    """select r.id, s.snapshot_id, s.snapshot_id is null as missing from (select id, 'r' || cast(id % 3 as varchar) as repo_id, md5(p_name || cast(p_partkey % 40 as varchar)) as digest
         from jobs left join part on p_partkey = id % 3000) r
       left join (select repo_id, digest, min(snapshot_id) as snapshot_id from snapshots group by all) s on s.repo_id = r.repo_id and s.digest = r.digest""",
)
def h9(fx):
    req = fx.jobs.select("id", (F.col("id") % 3000).alias("p_partkey")).join(fx.part, "p_partkey", "left")
    digest = F.md5(F.concat("p_name", (F.col("p_partkey") % 40).cast("string")).cast("binary"))
    req = req.select("id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id"), digest.alias("digest"))
    return so.resolve(req, fx.snapshots).select("id", "snapshot_id", "missing")


@check(
    "h10_scope",
    r"""select path_id, path from paths where not (path like 'media/%' or path = 'media' or list_contains(string_split(path, '/'), 'results')
        or regexp_full_match(path, '.*[.]yaml') or path = 'a' or path like 'a/%')""",
)
def h10(fx):
    return so.scope(fx.paths, ["/media/", "**/results/", "*.yaml"], ["a"]).select("path_id", "path")


@check(
    "h11_seed_state",
    r"""select 'p' || cast(job_id % 7 as varchar) as program, 'v' || cast(job_id % 3 as varchar) as version, max(job_id % 10000) as seed_max from artifacts
        where relative_path like '%results.jsonl' group by 1, 2""",
)
def h11(fx):
    i = F.col("job_id")
    path = F.concat(
        F.lit("base/programs/p"), (i % 7).cast("string"), F.lit("/v"), (i % 3).cast("string"),
        F.when(F.endswith("relative_path", F.lit("results.jsonl")), "/results/").otherwise("/other/"),
        F.format_string("%04d", i % 10000), F.lit("/"), F.col("relative_path"),
    )
    return so.seed_state(fx.artifacts.select(path.alias("path")), ["base/programs"])


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@check(
    "h13_scan_literals",
    rf"""select doc_id, i as line_no, trim(line, e' \t\n\r') as line from (select doc_id, unnest(string_split_regex(text, '{_ENDS}')) as line,
          generate_subscripts(string_split_regex(text, '{_ENDS}'), 1) as i from documents) t
        where contains(line, 'license') or contains(line, 'http') or contains(line, '(c)') or contains(line, 'License')""",
)
def h13(fx):
    return so.scan_literals(fx.documents, ["license", "http", "(c)", "License"])


# ---------------------------------------------------------------- traces


@check(
    "i1_trace_page",
    """
with t as (select conv_id * 1000 + turn as trace_id, 'run' || cast(conv_id % 3 as varchar) as environment, conv_id * 60 as timestamp, text as input
  from conversations), m as (select * from t where environment = 'run1')
select trace_id, timestamp, (select count(*) from m) as total_items, cast(ceil((select count(*) from m) / 10e0) as bigint) as total_pages,
  case when length(input) > 140 then left(input, 140) || '…' else coalesce(input, '') end as preview
from m order by timestamp desc, trace_id limit 10 offset 10""",
)
def i1(fx):
    c = F.col("conv_id")
    t = fx.conversations.select(
        (c * 1000 + F.col("turn")).alias("trace_id"), F.concat(F.lit("run"), (c % 3).cast("string")).alias("environment"), (c * 60).alias("timestamp"), F.col("text").alias("input")
    )
    return tr.trace_page(t, "run1", page=2, limit=10).select("trace_id", "timestamp", "total_items", "total_pages", "preview")


@check(
    "i3_trace_tree",
    """
with recursive rooted as (select trace_id, bool_or(parent_id is null) as rooted from observations group by trace_id),
o as (select x.*, r.rooted from observations x join rooted r on r.trace_id = x.trace_id),
tree as (select trace_id, obs_id, 0 as depth, [struct_pack(s := start_s, i := obs_id)] as path from o where parent_id is null or not rooted
  union all select c.trace_id, c.obs_id, t.depth + 1, list_append(t.path, struct_pack(s := c.start_s, i := c.obs_id))
  from tree t join o c on c.trace_id = t.trace_id and c.parent_id = t.obs_id where c.rooted)
select trace_id, obs_id, cast(depth as bigint) as depth, row_number() over (partition by trace_id order by path) as position from tree""",
)
def i3(fx):
    return tr.trace_tree(fx.observations).select("trace_id", "obs_id", "depth", "position")


_STATS = """count(*) as observations, cast(sum(total_tokens) as bigint) as total_tokens, count(case when upper(level) = 'ERROR' then 1 end) as errors,
  round(sum(total_cost), 6) as total_cost, round(avg(end_s - start_s), 6) as avg_latency_s, max(end_s) - min(start_s) as span_s"""


def _rounded_stats(df):
    return df.withColumns({c: F.round(c, 6) for c in ("total_cost", "avg_latency_s")})


@check("i4_trace_stats", f"select trace_id, {_STATS} from observations group by trace_id")
def i4(fx):
    return _rounded_stats(tr.trace_stats(fx.observations))


@check("i4_model_stats", f"select model, type, {_STATS} from observations group by model, type")
def i4_model(fx):
    return _rounded_stats(tr.trace_stats(fx.observations, ["model", "type"]))


@check(
    "i5_sample_traces",
    "select conv_id, turn from conversations where ('0x' || substr(md5('4:' || cast(conv_id as varchar)), 1, 13))::bigint / 4503599627370496e0 < 0.3e0",
)
def i5(fx):
    return tr.sample_traces(fx.conversations, 0.3, seed=4, trace="conv_id").select("conv_id", "turn")
