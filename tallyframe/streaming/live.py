"""Live behaviours as Structured Streaming operators; most also run unchanged on batch tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from tallyframe.operators import logs
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import ROWS_PER_CHUNK, Running, int_chunk, running, time_chunk
from tallyframe.streaming.sinks import as_event_time, fold_sink


def live_progress(lines: DataFrame, job: str = "job_id", seq: str = "seq", text: str = "line") -> DataFrame:
    """Latest progress per job, for update mode. State is one small row per job, and lines are folded
    map-side before the shuffle, so a job that prints most of the lines is no hot spot."""
    folded = logs.progress_facts(lines, text).groupBy(job).agg(*logs.progress_folds(seq))
    status = F.when(F.col("__status").isNotNull(), logs.status_struct(F.col("__status")))
    told = folded.withColumns({"phase": logs.phase_of(), **logs.bar_columns(), "__f": status}).select("*", "__f.*")
    return logs.with_percent(told).withColumn("rows_pct", F.when(F.col("__f").isNotNull(), F.col("rows_pct"))).select(
        job, "phase", "rollouts_cur", "rollouts_total", "rollouts_pct", "remaining", "rate", "budget", "last_iteration", "best_score",
        "front_score", "new_candidates", "rows_done", "rows_total", "rows_pct", "acc_pct", "tokens_total", "tokens_in", "tokens_out",
        "cost_usd", "cost_per_1k_rows", "avg_ms", "med_ms", "eta", "errors", "last_error",
    )


def last_seen(heartbeats: DataFrame, worker: str = "worker_id", ts: str = "ts") -> DataFrame:
    """Latest heartbeat per worker, for update mode; liveness is judged against ``now`` when read."""
    return heartbeats.groupBy(worker).agg(F.max(ts).alias("last_seen"))


def lease_sessions(heartbeats: DataFrame, lease: str, delay: str, worker: str = "worker_id", ts: str = "ts") -> DataFrame:
    """Held intervals on a stream: a closed session is a worker that went silent for a whole lease.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition=true`` to merge
    a busy worker's beats before the shuffle.
    """
    timed = as_event_time(heartbeats, ts, delay)
    out = timed.groupBy(worker, F.session_window(ts, lease).alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return out.select(worker, F.col("w.start").alias("held_from"), F.col("w.end").alias("held_until"), "beats")


def lease_intervals(
    heartbeats: DataFrame, lease_seconds: int, worker: str = "worker_id", ts: str = "ts", chunk_seconds: int = 3600
) -> DataFrame:
    """Batch twin of ``lease_sessions`` for workers with any number of beats.

    Beats are joined into intervals inside each (worker, time chunk) first, what is left inside each day of chunks next. A
    day's beats all come after those of earlier days, so only its first interval can continue an earlier one: one row per
    (worker, day) carries how many intervals began before it. Beats without a time have no interval.
    """
    beats = heartbeats.filter(F.col(ts).isNotNull()).groupBy(worker, F.col(ts).cast("timestamp").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    inside = W.partitionBy(worker, "__c").orderBy("__t")
    apart = lambda a, b: F.coalesce((F.unix_micros(b) - F.unix_micros(a) > lease_seconds * 1_000_000).cast("int"), F.lit(1))
    tagged = beats.withColumn("__c", time_chunk("__t", chunk_seconds)).withColumn("__p", F.lag("__t").over(inside))
    tagged = tagged.withColumn("__i", F.sum(apart(F.col("__p"), F.col("__t"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    partial = tagged.groupBy(worker, "__c", "__i").agg(F.min("__t").alias("__from"), F.max("__t").alias("__to"), F.sum("__n").alias("__n"))
    # A struct as key: its NULL worker joins like any other.
    day = F.struct(F.col(worker).alias("w"), F.floor(F.col("__c") / 24).cast("bigint").alias("d")).alias("__day")
    partial = partial.select(day, "__from", "__to", "__n").repartition("__day")  # never by the worker alone
    row = W.partitionBy("__day").orderBy("__from")
    began = F.when(F.lag("__to").over(row).isNull(), 0).otherwise(apart(F.lag("__to").over(row), F.col("__from")))
    local = partial.withColumn("__b", began).withColumn("__l", F.sum("__b").over(row.rowsBetween(W.unboundedPreceding, 0)))
    days = durable(
        local.groupBy("__day", "__l").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"), F.sum("__n").alias("__n")), "days"
    )
    ends = days.groupBy("__day").agg(F.min("__from").alias("__first"), F.max("__to").alias("__last"), F.max("__l").alias("__more"))
    order = W.partitionBy("__day.w").orderBy("__day.d")
    ends = ends.withColumn("__new", apart(F.lag("__last").over(order), F.col("__first")))
    before = F.sum(F.col("__new") + F.col("__more")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__more")
    carried = ends.select("__day", before.alias("__before"))
    lease = F.expr(f"interval {int(lease_seconds)} seconds")
    return (
        days.join(carried, "__day")
        .groupBy(F.col("__day.w").alias(worker), (F.col("__before") + F.col("__l")).alias("__g"))
        .agg(F.min("__from").alias("held_from"), (F.max("__to") + lease).alias("held_until"), F.sum("__n").alias("beats"))
        .drop("__g")
    )


def fenced_writes(writes: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Writes whose (worker, attempt) token still owns the job, as ``jobs`` says it.

    On a stream run it in ``sinks.lookup_sink`` with a jobs table read per micro-batch: joined directly, a table keeps
    the files it had when the query began.
    """
    owners = jobs.filter(F.col("worker_id").isNotNull()).select(F.col("id").alias(job), "worker_id", "attempt")
    return writes.join(owners, [job, "worker_id", "attempt"], "left_semi")


def write_outcomes(writes: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Every write marked ``accepted`` or stale, to count what fencing drops (on a stream as ``fenced_writes``)."""
    owners = jobs.filter(F.col("worker_id").isNotNull()).select(
        F.col("id").alias(job), "worker_id", "attempt", F.lit(True).alias("__owner")
    )
    return writes.join(owners, [job, "worker_id", "attempt"], "left").withColumn(
        "accepted", F.coalesce("__owner", F.lit(False))
    ).drop("__owner")


def _filled(df: DataFrame, c: str) -> Column:
    """Whole numbers with NULL as 0: pandas would turn a frame's numbers into floats beside one NULL."""
    kind = df.schema[c].dataType
    return F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c) if isinstance(kind, T.IntegralType) else F.col(c)


def _with_held(state: GroupState, new: list[pd.DataFrame]) -> pd.DataFrame | None:
    """New rows after those a bucket holds; None without any."""
    frames = [pdf for pdf in new if len(pdf)]
    if state.exists:
        frames.insert(0, pa.ipc.open_stream(state.get[0]).read_pandas())
    return pd.concat(frames, ignore_index=True) if frames else None


def _hold(state: GroupState, rows: pd.DataFrame, wake_ms: int | None) -> None:
    """Keep rows as one Arrow stream until the watermark reaches ``wake_ms``; without rows the state ends."""
    if len(rows):
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        if wake_ms is not None:
            state.setTimeoutTimestamp(max(wake_ms, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def _same_as_before(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Whether each row has the key of the row before it."""
    same = np.ones(len(rows), bool)
    for k in keys:
        values = rows[k].to_numpy()
        same[1:] &= values[1:] == values[:-1]
    same[:1] = False
    return same


def pair_call_stream(
    events: DataFrame, max_seconds: int, delay: str, keys: Sequence[str] = ("scope", "call_id"), ts: str = "ts", buckets: int = 512
) -> DataFrame:
    """``usage.pair_calls`` on a stream of start and end events (``kind``, ``name``, ``exception``), with state per bucket of calls.

    Events wait until the watermark has passed them, so they are paired in event order whatever order they came in: a
    repeated start replaces the earlier one, a repeated end is ignored, an id may be used again. An open start is
    dropped by a timer ``max_seconds`` after it began, so state ends with the calls. Events without a full key or a time drop out.

    Calls are hashed into ``buckets``, and a bucket's events are paired in one pass over arrays, so the cost is that of the
    events, not of a Python call per call id. A bucket's open events are read and written together: take more buckets where more
    than some millions of events wait in one. Their number is part of the checkpoint.
    """
    keys, at = list(keys), F.unix_micros(F.col(ts).cast("timestamp"))
    whole = F.lit(True)
    for c in (*keys, ts):
        whole = whole & F.col(c).isNotNull()
    # Rows that are not whole are not filtered here: they still move the watermark. Their time spreads them over the buckets.
    bucket = F.pmod(F.xxhash64(*keys, F.when(~whole, at)), F.lit(buckets)).cast("int")
    timed = as_event_time(
        events.withColumns({"__bucket": bucket, "__whole": whole, "__t": F.coalesce(at, F.lit(0)), "__end": F.col("kind") != "start"}), ts, delay
    ).select("__bucket", ts, "__whole", *[_filled(events, k) for k in keys], "__t", F.coalesce("__end", F.lit(True)).alias("__end"), "name", "exception")
    fields = [*[events.schema[k] for k in keys], events.schema["name"], events.schema["exception"]]
    out = T.StructType([*fields, T.StructField("__from", T.LongType()), T.StructField("__to", T.LongType())])
    names, limit, held = out.names, max_seconds * 1_000_000, [*keys, "__t", "__end", "name", "exception"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _with_held(state, [] if state.hasTimedOut else [pdf.loc[pdf["__whole"], held] for pdf in frames])
        if rows is None:
            yield pd.DataFrame([], columns=names)
            return
        passed = state.getCurrentWatermarkMs() * 1000
        rows = rows.sort_values([*keys, "__t", "__end"], kind="stable", ignore_index=True)  # at equal times a start comes before its end
        t, end, done = rows["__t"].to_numpy(), rows["__end"].to_numpy(dtype=bool), rows["__t"].to_numpy() <= passed
        same = _same_as_before(rows, keys)
        # An event that the watermark has passed closes or replaces the open start right before it.
        paired = np.flatnonzero(done & end & same & ~np.roll(end, 1) & (t - np.roll(t, 1) <= limit))
        followed = np.append(same[1:] & done[1:], False)
        opened = done & ~end & ~followed & (t + limit > passed)
        keep = opened | ~done
        wake = np.where(done, t + limit, t)[keep]
        _hold(state, rows[keep], int(wake.min()) // 1000 + 1 if len(wake) else None)
        pairs = rows.loc[paired, [*keys, "name", "exception"]].reset_index(drop=True)
        pairs["name"] = rows["name"].to_numpy()[paired - 1]
        yield pairs.assign(__from=t[paired - 1], __to=t[paired])

    paired = timed.groupBy("__bucket").applyInPandasWithState(step, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return paired.select(
        *keys, "name", "exception", F.timestamp_micros("__from").alias("started_at"), F.timestamp_micros("__to").alias("ended_at"),
        ((F.col("__to") - F.col("__from")) / 1e6).alias("latency_seconds"),
    )


def ingest_once(lines: DataFrame, delay: str, keys: Sequence[str] = ("job_id", "seq"), ts: str = "ts") -> DataFrame:
    """Each (job, seq) passes once, with state bounded by the watermark delay."""
    return as_event_time(lines, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def sequence_gaps(rows: DataFrame, job: str = "job_id", seq: str = "seq", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``(job, after_seq, before_seq, missing)`` for every hole between neighbouring sequence numbers."""
    marks = rows.select(job, seq).distinct()
    linked = running(marks, [job], [F.col(seq)], int_chunk(seq, rows_per_chunk), [Running("after_seq", "max", F.col(seq), before=True)], True)
    return linked.filter(F.col(seq) - F.col("after_seq") > 1).select(
        job, "after_seq", F.col(seq).alias("before_seq"), (F.col(seq) - F.col("after_seq") - 1).alias("missing")
    )


def gap_monitor(
    lines: DataFrame, path: str, checkpoint: str, job: str = "job_id", seq: str = "seq", every: str | None = None
) -> StreamingQuery:
    """Gaps on a stream: each micro-batch is checked together with the last number seen per job.

    Numbers at or below the last one seen are late and do not reopen a gap. Output lies under
    ``<path>/out``, the last numbers under ``<path>/state``.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.select(job, seq)
        if before is not None:
            last = before.withColumnRenamed(seq, "__last")
            rows = rows.join(last, job, "left").filter(F.col("__last").isNull() | (F.col(seq) > F.col("__last"))).select(job, seq)
            rows = rows.unionByName(before)
        return sequence_gaps(rows, job, seq), rows.groupBy(job).agg(F.max(seq).alias(seq))

    return fold_sink(lines, path, checkpoint, step, every)


def _needed(workers: np.ndarray, beats: np.ndarray, lease: int) -> np.ndarray:
    """Which of the beats, sorted by worker and time, are the first or last of their worker in a lease-long slot: the silences stay the same."""
    slots, new = beats // lease, np.ones(len(beats), bool)
    new[1:] = (workers[1:] != workers[:-1]) | (slots[1:] != slots[:-1])
    return new | np.append(new[1:], True)


def _thinned(beats: list[int], lease: int) -> list[int]:
    """Sorted beats of one worker without those that no silence begins or ends at."""
    times = np.asarray(beats, "int64")
    return times[_needed(np.zeros(len(times)), times, lease)].tolist() if len(times) else []


#: What a row of a bucket's state says: a beat that waits, or the last beat told of, of a worker alive or lost.
_WAITS, _ALIVE, _LOST = 0, 1, 2


def liveness_events(
    heartbeats: DataFrame, lease_seconds: int, delay: str, worker: str = "worker_id", ts: str = "ts", buckets: int = 512
) -> DataFrame:
    """worker, event, at: "lost" a lease after a worker's last beat, sent by a timer without any input, and "back" at its next.

    The events equal the silences of ``lease_intervals``, whatever order beats come in within ``delay``. State per worker is one
    beat, one flag and, for the stretch the watermark has not passed, about two beats a lease. Beats are thinned in the
    reading tasks, so a worker with most of the beats is no hot key. Workers are hashed into ``buckets``, and a bucket is
    told of in one pass over arrays: no Python call per worker. A bucket's state is read and written together; take more
    buckets for more than some millions of workers. Their number is part of the checkpoint.
    """
    lease = lease_seconds * 1_000_000

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pdf.sort_values(["worker", "beat"])
            yield rows[_needed(rows["worker"].to_numpy(), rows["beat"].to_numpy(), lease)] if len(rows) else rows

    beat = F.unix_micros(F.col(ts).cast("timestamp"))
    # Beats of no worker only move the watermark; their time spreads them over the buckets.
    bucket = F.pmod(F.xxhash64(worker, F.when(F.col(worker).isNull(), beat)), F.lit(buckets)).cast("int")
    kind = heartbeats.schema[worker].dataType.simpleString()
    beats = heartbeats.select(
        bucket.alias("bucket"), F.col(worker).isNotNull().alias("known"), _filled(heartbeats, worker).alias("worker"), beat.alias("beat")
    ).filter("beat is not null")
    thinned = beats.mapInPandas(thin, f"bucket int, known boolean, worker {kind}, beat bigint")
    timed = thinned.withColumn("__ts", F.timestamp_micros("beat")).withWatermark("__ts", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [] if state.hasTimedOut else [pdf.loc[pdf["known"], ["worker", "beat"]].assign(told=_WAITS) for pdf in frames]
        rows = _with_held(state, new)
        if rows is None:
            yield pd.DataFrame([], columns=["worker", "event", "__at"])
            return
        passed = state.getCurrentWatermarkMs() * 1000
        # Beats at or before what was told of are old news.
        rows = rows.sort_values(["worker", "beat", "told"], ascending=[True, True, False], kind="stable")
        by = rows.groupby("worker", sort=False)["told"]
        rows = rows[(by.transform("max") == _WAITS) | (by.cummax() != _WAITS)].drop_duplicates(["worker", "beat"]).reset_index(drop=True)
        waits = rows["told"].to_numpy() == _WAITS
        rows = rows[~waits | _needed(rows["worker"].to_numpy(), rows["beat"].to_numpy(), lease)].reset_index(drop=True)
        workers, t, told = rows["worker"].to_numpy(), rows["beat"].to_numpy(), rows["told"].to_numpy()
        same = _same_as_before(rows, ["worker"])
        done = (told != _WAITS) | (t < passed)
        before, lost_before = np.roll(t, 1), np.roll(told, 1) == _LOST
        back = done & same & (t - before > lease)
        silent = back & ~lost_before
        following = np.append(same[1:], False)
        last = done & ~np.append(same[1:] & done[1:], False)
        met = following & (np.roll(t, -1) - t <= lease)
        lost = last & (told != _LOST) & (t + lease < passed) & ~met
        told = np.where(lost | (last & (told == _LOST)), _LOST, np.where(last, _ALIVE, _WAITS))
        keep = last | ~done
        wake = np.where(done, t + lease, t)[keep & (told != _LOST)]
        _hold(state, rows.assign(told=told)[keep], max(int(wake.min()) // 1000, 0) if len(wake) else None)
        yield pd.DataFrame(
            {
                "worker": np.concatenate([workers[silent], workers[back], workers[lost]]),
                "event": ["lost"] * int(silent.sum()) + ["back"] * int(back.sum()) + ["lost"] * int(lost.sum()),
                "__at": np.concatenate([before[silent] + lease, t[back], t[lost] + lease]),
            }
        )

    out = f"worker {kind}, event string, __at bigint"
    events = timed.groupBy("bucket").applyInPandasWithState(step, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return events.select(F.col("worker").alias(worker), "event", F.timestamp_micros("__at").alias("at"))


class _Gaps(StatefulProcessor):
    """Per job: the last number seen."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long", self.ttl_ms) if self.ttl_ms else handle.getValueState("last", "seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((int(initialState["seq"].max()),))

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        gaps, first = [], last
        stretches = sorted({x for pdf in rows for x in zip(pdf["first"].tolist(), pdf["until"].tolist())})
        for a, b in stretches:
            if last is not None and b <= last:
                continue  # late, or seen by another task of this batch
            if last is not None and a - last > 1:
                gaps.append((last, a, a - last - 1))
            last = b
        if last is not None and last != first and key[0] is not None:
            self.last.update((last,))
        if key[0] is None:
            gaps = []
        yield pd.DataFrame({"job": pd.array([key[0]] * len(gaps), "object"), "after_seq": pd.array([g[0] for g in gaps], "int64"), "before_seq": pd.array([g[1] for g in gaps], "int64"), "missing": pd.array([g[2] for g in gaps], "int64")})

    def close(self) -> None:
        pass


def gap_stream(lines: DataFrame, job: str = "job_id", seq: str = "seq", ttl: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """``gap_monitor`` with state per job: (job, after_seq, before_seq, missing) of every hole, as a stream of its own.

    The state is one number per job; a micro-batch reads and writes those of its own jobs only. ``ttl`` seconds without
    lines remove a job's state, ``before`` (job, seq) holds last numbers to start from. Reading tasks send stretches of
    neighbouring numbers, so a job with most of the lines sends few rows. Start it with ``sinks.append_sink(.., rocks=True)``.
    """

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pdf.dropna(subset=["seq"]).drop_duplicates().sort_values(["job", "seq"])
            new = (rows["job"] != rows["job"].shift()) | (rows["seq"] != rows["seq"].shift() + 1)
            yield rows.groupby([rows["job"], new.cumsum()], dropna=False)["seq"].agg(first="min", until="max").reset_index(level=0)

    kind = lines.schema[job].dataType.simpleString()
    sent = lines.select(F.col(job).alias("job"), F.col(seq).cast("bigint").alias("seq")).mapInPandas(stretches, f"job {kind}, first bigint, until bigint")
    start = before.select(F.col(job).alias("job"), F.col(seq).cast("bigint").alias("seq")).groupBy("job") if before is not None else None
    out = sent.groupBy("job").transformWithStateInPandas(
        _Gaps(ttl * 1000 if ttl else None), f"job {kind}, after_seq bigint, before_seq bigint, missing bigint", "Append", "ProcessingTime" if ttl else "None", start
    )
    return out.withColumnRenamed("job", job)


def cancel_decisions(requests: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Outcome of each cancel request: queued jobs end now, running ones are asked to stop, others
    conflict, unknown ones are not found. On a stream run it in ``sinks.lookup_sink``."""
    known = jobs.select(F.col("id").alias(job), "status")
    outcome = (
        F.when(F.col("status").isNull(), "not found")
        .when(F.col("status") == "queued", "cancelled")
        .when(F.col("status") == "running", "requested")
        .otherwise("conflict")
    )
    return requests.join(known, job, "left").withColumn("outcome", outcome)


def pending_cancels(jobs: DataFrame) -> DataFrame:
    """Running jobs with the cancel flag set: signalled again on every tick until they stop."""
    return jobs.filter((F.col("status") == "running") & F.col("cancel_requested")).select("id", "worker_id", "attempt")


def cancel_signals(ticks: DataFrame, jobs: DataFrame, ts: str = "ts") -> DataFrame:
    """Pending cancels, once for the newest tick of a micro-batch; run it in ``sinks.lookup_sink``.

    Every tick signals all running jobs that are still asked to stop, until the jobs table says they have.
    """
    now = ticks.agg(F.max(ts).alias("signalled_at")).filter("signalled_at is not null")
    return pending_cancels(jobs).withColumn("signalled_at", now.scalar()).filter("signalled_at is not null")


def throughput(
    results: DataFrame, width: str, slide: str | None = None, by: Sequence[str] = (), ts: str = "ts", values: dict[str, Column] | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Rows and sums per tumbling or sliding window (batch, or a stream when ``delay`` is given)."""
    timed = as_event_time(results, ts, delay) if delay else results.withColumn(ts, F.col(ts).cast("timestamp"))
    sums = [F.sum(c).alias(n) for n, c in (values or {}).items()]
    out = timed.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows", *(values or {}))
