"""L: streams, replayed from files and compared with their batch meaning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.checks.check_logs import _LATEST, _STATUS, PHASE_SQL, PROGRESS_SQL
from tallyframe.checks.check_usage import _CALLS
from tallyframe.checks.registry import check
from tallyframe.operators import storage as so
from tallyframe.plans.durable import scratch
from tallyframe.sources import versions
from tallyframe.streaming import live, sinks

# The replayed files arrive in any order, so the delay covers the whole span of the data.
DELAY = "60 days"
SENTINEL = "2100-01-01 00:00:00"


#: Rows of one replayed file at most, about: a task that writes or reads a file does not grow with the table.
FILE_ROWS = 500_000


def replay(df: DataFrame, ts: str = "ts", files: int = 4, flush: bool = False, file_rows: int = FILE_ROWS) -> DataFrame:
    """The table as a file stream in two micro-batches; ``flush`` ends it with a far-future row. ``files`` at least, in steps of ``files``."""
    spark = df.sparkSession
    folder = scratch(spark, "replay")
    files *= max(1, math.ceil(df.count() / (files * file_rows)))
    df.repartitionByRange(files, ts).write.parquet(folder)
    per_trigger = max(1, math.ceil(len(spark.read.schema(df.schema).parquet(folder).inputFiles()) / 2))
    if flush:
        last = [F.lit(SENTINEL).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        spark.range(1).select(*last).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def arrivals(df: DataFrame, number: Column, n: int) -> DataFrame:
    """The rows as a file stream whose micro-batch ``i`` holds the rows with ``number`` i, 0 to n - 1.

    Every reading task writes its own rows of an arrival: nothing is shuffled, and files grow in number with the table, not in size.
    A micro-batch is a fixed number of files, so arrivals that differ in it (a task had no row of one) are dealt out evenly instead.
    """
    spark = df.sparkSession
    for deal in (lambda d: d, lambda d: d.repartition(4), lambda d: d.coalesce(1)):  # one task writes a file even without rows
        folder, files = scratch(spark, "arrivals"), [0]
        for i in range(n):
            deal(df.filter(number == i)).write.mode("append").option("compression", "zstd").parquet(folder)
            files.append(len(spark.read.schema(df.schema).parquet(folder).inputFiles()))
            if files[-1] != (i + 1) * files[1]:
                break
        else:
            break
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files[1]).parquet(folder)


def appended(stream: DataFrame, rocks: bool = False) -> DataFrame:
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "out")
    sinks.append_sink(stream, out, scratch(spark, "state"), rocks=rocks).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def looked_up(stream: DataFrame, step) -> DataFrame:
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "out")
    sinks.lookup_sink(stream, out, scratch(spark, "state"), step).awaitTermination()
    return spark.read.parquet(out)


def upserted(stream: DataFrame, keys: list[str]) -> DataFrame:
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "out")
    sinks.upsert_sink(stream, out, scratch(spark, "state")).awaitTermination()
    return sinks.read_latest(spark, out, keys)


def _seconds(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


@check(
    "l1_live_progress",
    f"""with {_STATUS}, {_LATEST}, {PROGRESS_SQL.strip()}, {PHASE_SQL}
select pp.job_id, phase, rollouts_cur, rollouts_total, rollouts_pct, remaining, rate, budget, last_iteration, best_score, front_score, new_candidates,
  l.rows_done, l.rows_total, round(100e0 * l.rows_done / l.rows_total, 1) as rows_pct, l.acc_pct, l.tokens_total, l.tokens_in, l.tokens_out, l.cost_usd,
  round(l.cost_usd * 1000 / l.rows_done, 4) as cost_per_1k_rows, l.avg_ms, l.med_ms, l.eta, errors, last_error
from pp join ph on ph.job_id = pp.job_id left join l on l.job_id = pp.job_id
join (select job_id, count(case when regexp_matches(line, 'ERROR .|Traceback.|AdapterParseError.') then 1 end) as errors,
  arg_max(regexp_extract(line, '(ERROR [^\\n]+|Traceback[^\\n]+|AdapterParseError[^\\n]+)', 1), seq) filter (regexp_matches(line, 'ERROR .|Traceback.|AdapterParseError.')) as last_error
  from log_lines group by job_id) er on er.job_id = pp.job_id""",
)
def l1(fx):
    return upserted(live.live_progress(replay(fx.log_lines)), ["job_id"])


_LIVE_SQL = """select worker_id, epoch_us(max(ts)) // 1000000 as last_seen_s, max(ts) > (select max(ts) from heartbeats) - interval 6 hour as live
  from heartbeats group by worker_id"""


def _latest(fx):
    return fx.events.agg(F.max("ts").cast("string")).first()[0]


@check("l2_worker_liveness", _LIVE_SQL)
def l2(fx):
    out = so.live_workers(fx.heartbeats, _latest(fx), 6 * 3600)
    return out.select("worker_id", _seconds("last_seen").alias("last_seen_s"), "live")


@check("l2_worker_liveness_stream", _LIVE_SQL)
def l2_stream(fx):
    seen = upserted(live.last_seen(replay(fx.heartbeats)), ["worker_id"]).withColumnRenamed("last_seen", "ts")
    out = so.live_workers(seen, _latest(fx), 6 * 3600)
    return out.select("worker_id", _seconds("last_seen").alias("last_seen_s"), "live")


@check(
    "l2_liveness_events_stream",
    """with b as (select worker_id, ts, lead(ts) over (partition by worker_id order by ts) as nxt from heartbeats where worker_id is not null)
select worker_id, 'lost' as event, epoch_us(ts) // 1000000 + 21600 as at_s from b where nxt is null or nxt - ts > interval 6 hour
union all select worker_id, 'back', epoch_us(nxt) // 1000000 from b where nxt - ts > interval 6 hour""",
)
def l2_events(fx):
    """Beats come in four files in any order; the far-future row moves the watermark past the last lease."""
    out = appended(live.liveness_events(replay(fx.heartbeats, flush=True), 6 * 3600, DELAY), rocks=True)
    return out.select("worker_id", "event", _seconds("at").alias("at_s"))


_LEASE_SQL = """
with g as (select worker_id, ts, case when ts - lag(ts) over (partition by worker_id order by ts) <= interval 6 hour then 0 else 1 end as b from heartbeats),
i as (select worker_id, ts, sum(b) over (partition by worker_id order by ts, b desc rows between unbounded preceding and current row) as i from g)
select worker_id, epoch_us(min(ts)) // 1000000 as from_s, epoch_us(max(ts)) // 1000000 + 21600 as until_s, count(*) as beats from i group by worker_id, i"""


def _lease(df):
    return df.select("worker_id", _seconds("held_from").alias("from_s"), _seconds("held_until").alias("until_s"), "beats")


@check("l3_lease_intervals", _LEASE_SQL)
def l3(fx):
    return _lease(live.lease_intervals(fx.heartbeats, 6 * 3600, chunk_seconds=7 * 86400))


@check("l3_lease_sessions_stream", _LEASE_SQL)
def l3_stream(fx):
    out = appended(live.lease_sessions(replay(fx.heartbeats, flush=True), "6 hours", DELAY))
    return _lease(out.filter(F.col("worker_id").isNotNull()))


_FENCED_SQL = """select a.job_id, a.attempt, a.relative_path, a.tiebreak, a.size_bytes from artifacts a
  where exists (select 1 from jobs j where j.id = a.job_id and j.attempt = a.attempt and j.worker_id = 'w' || cast(a.job_id % 1500 % 150 as varchar))"""


@check(
    "f3_upsert_versioned_stream",
    """select worker_id, event_id, epoch_us(ts) // 1000000 as ts_s from (select *, row_number() over (partition by worker_id order by ts desc, event_id desc) as r from heartbeats) t where r = 1""",
)
def f3_stream(fx):
    root = scratch(fx.spark, "versions")
    sinks.versioned_sink(replay(fx.heartbeats), root, scratch(fx.spark, "state"), ["worker_id"], ["ts"]).awaitTermination()
    return versions.read_version(fx.spark, root).select("worker_id", "event_id", _seconds("ts").alias("ts_s"))


@check("l4_fenced_writes_stream", _FENCED_SQL)
def l4(fx):
    writes = fx.artifacts.withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 1500 % 150).cast("string")))
    out = looked_up(replay(writes, "created_at"), lambda batch: live.fenced_writes(batch, fx.jobs))
    return out.select("job_id", "attempt", "relative_path", "tiebreak", "size_bytes")


@check(
    "l4_write_outcomes_stream",
    """select coalesce(j.worker_id = 'w' || cast(a.job_id % 1500 % 150 as varchar) and j.attempt = a.attempt, false) as accepted, a.relative_path, count(*) as writes
       from artifacts a left join jobs j on j.id = a.job_id group by 1, 2""",
)
def l4_outcomes(fx):
    writes = fx.artifacts.withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 1500 % 150).cast("string")))
    out = looked_up(replay(writes, "created_at"), lambda batch: live.write_outcomes(batch, fx.jobs))
    return out.groupBy("accepted", "relative_path").agg(F.count(F.lit(1)).alias("writes"))


# Too late is what the watermark had passed when the batch before began: the engine judges late rows one batch behind.
_COUNTS_SQL = """
with w as (select *, ascii(tiebreak) % 4 as batch, 'w' || cast(job_id % 1500 % 150 as varchar) as worker_id from artifacts),
top as (select batch, max(created_at) as top from w group by batch),
marked as (select w.*, created_at <= (select max(top) from top where top.batch <= w.batch - 2) - interval 60 day as late,
  row_number() over (partition by job_id, attempt, relative_path, size_bytes, digest, created_at, tiebreak order by batch) as nth from w),
fated as (select m.*, coalesce(late, false) as too_late, exists (select 1 from jobs j where j.id = m.job_id and j.attempt = m.attempt and j.worker_id = m.worker_id) as owns from marked m)
select cast(batch as bigint) as batch_id, count(case when not too_late and nth = 1 and owns then 1 end) as accepted, count(case when not too_late and nth = 1 and not owns then 1 end) as stale,
  count(case when too_late then 1 end) as too_late, count(case when not too_late and nth > 1 then 1 end) as repeated from fated group by batch"""


@check("l4_write_counts_stream", _COUNTS_SQL)
def l4_counts(fx):
    """Four arrivals, each a mix of all dates, so that the watermark passes most of what comes later."""
    writes = fx.artifacts.withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 1500 % 150).cast("string")))
    stream, out = arrivals(writes, F.ascii("tiebreak") % 4, 4), scratch(fx.spark, "counted")
    keys = ["job_id", "attempt", "relative_path", "size_bytes", "digest", "created_at", "tiebreak"]
    marks = {"accepted": F.col("accepted"), "stale": ~F.col("accepted")}
    query, drops = sinks.counted_sink(
        stream, out, scratch(fx.spark, "state"), lambda batch: live.write_outcomes(batch, fx.jobs), marks, "created_at", "60 days", keys
    )
    query.awaitTermination()
    drops.wait()
    return sinks.read_counts(fx.spark, out).withColumn("batch_id", F.col("batch_id").cast("bigint"))


@check(
    "l5_pair_calls_stream", f"with {_CALLS} select scope, call_id, name, exception, round(latency_seconds, 6) as latency_seconds from c"
)
def l5(fx):
    out = appended(live.pair_call_stream(replay(fx.calls, flush=True), 30 * 86400, DELAY))
    return out.select("scope", "call_id", "name", "exception", F.round("latency_seconds", 6).alias("latency_seconds"))


@check("l6_ingest_once_stream", "select job_id, seq, line from log_lines")
def l6(fx):
    twice = fx.log_lines.unionByName(fx.log_lines)
    return appended(live.ingest_once(replay(twice), DELAY)).select("job_id", "seq", "line")


_GAPS_SQL = """select job_id, seq as after_seq, nxt as before_seq, nxt - seq - 1 as missing from (
  select conv_id as job_id, turn as seq, lead(turn) over (partition by conv_id order by turn) as nxt from conversations where role <> 'assistant') t where nxt - seq > 1"""


def _holes(fx):
    """Turns as a log whose assistant lines got lost."""
    c = fx.conversations.filter("role <> 'assistant'")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"))


@check("l7_sequence_gaps", _GAPS_SQL)
def l7(fx):
    return live.sequence_gaps(_holes(fx))


@check("l7_gap_monitor_stream", _GAPS_SQL)
def l7_stream(fx):
    """Numbers arrive in order per job, a few turns per micro-batch."""
    spark, folder, out = fx.spark, scratch(fx.spark, "replay"), scratch(fx.spark, "gaps")
    rows = _holes(fx)
    for part in ("seq < 2", "seq >= 2 and seq < 4", "seq >= 4"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live.gap_monitor(stream, out, scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(f"{out}/out").drop(sinks.BATCH)


@check("l7_gap_state_stream", _GAPS_SQL)
def l7_state(fx):
    """The same turns through state per job."""
    spark, folder = fx.spark, scratch(fx.spark, "replay")
    rows = _holes(fx)
    for part in ("seq < 2", "seq >= 2 and seq < 4", "seq >= 4"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return appended(live.gap_stream(stream), rocks=True)


_CANCEL_SQL = """select r.seq, r.job_id, case when j.id is null then 'not found' when j.status = 'queued' then 'cancelled' when j.status = 'running' then 'requested'
  else 'conflict' end as outcome from (select seq, seq * 2 as job_id from job_events) r left join jobs j on j.id = r.job_id"""


def _cancels(fx):
    return fx.events.select(F.col("event_id").alias("seq"), (F.col("event_id") * 2).alias("job_id"), "ts")


@check("l8_cancel_decisions", _CANCEL_SQL)
def l8(fx):
    return live.cancel_decisions(_cancels(fx), fx.jobs).select("seq", "job_id", "outcome")


@check("l8_cancel_stream", _CANCEL_SQL)
def l8_stream(fx):
    out = looked_up(replay(_cancels(fx)), lambda batch: live.cancel_decisions(batch, fx.jobs))
    return out.select("seq", "job_id", "outcome")


@check("l8_cancel_signals_stream", "select id, worker_id, attempt, 2 as signals from jobs where status = 'running' and cancel_requested")
def l8_signals(fx):
    """Four files of ticks in two micro-batches: every pending cancel is signalled twice."""
    out = looked_up(replay(fx.events.select("ts")), lambda batch: live.cancel_signals(batch, fx.jobs))
    return out.groupBy("id", "worker_id", "attempt").agg(F.count(F.lit(1)).alias("signals"))


@check("l8_pending_cancels", "select id, worker_id, attempt from jobs where status = 'running' and cancel_requested")
def l8_pending(fx):
    return live.pending_cancels(fx.jobs)


_TUMBLING_SQL = """select epoch_us(time_bucket(interval 6 hour, ts, timestamp '1970-01-01')) // 1000000 as start_s, event_type, count(*) as rows, round(sum(value), 4) as cost
  from events group by 1, 2"""


def _windows(df):
    return df.select(_seconds("window_start").alias("start_s"), "event_type", "rows", F.round("cost", 4).alias("cost"))


@check("l9_throughput_tumbling", _TUMBLING_SQL)
def l9(fx):
    return _windows(live.throughput(fx.events, "6 hours", by=["event_type"], values={"cost": F.col("value")}))


@check(
    "l9_throughput_sliding",
    """select epoch_us(time_bucket(interval 2 hour, ts, timestamp '1970-01-01')) // 1000000 - k * 7200 as start_s, event_type, count(*) as rows, round(sum(value), 4) as cost
       from events, (select unnest([0, 1, 2]) as k) o group by 1, 2""",
)
def l9_sliding(fx):
    return _windows(live.throughput(fx.events, "6 hours", "2 hours", ["event_type"], values={"cost": F.col("value")}))


@check("l9_throughput_stream", _TUMBLING_SQL)
def l9_stream(fx):
    stream = replay(fx.events.select("ts", "event_type", "value"), flush=True)
    out = appended(live.throughput(stream, "6 hours", by=["event_type"], values={"cost": F.col("value")}, delay=DELAY))
    return _windows(out.filter(F.col("event_type").isNotNull()))
