"""Stream behaviours that the replayed queries do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.durable import scratch
from tallyframe.streaming import live, sinks

T0 = dt.datetime(2001, 1, 1)


def files(spark, *frames):
    """One file per frame, read one per micro-batch in writing order."""
    folder = scratch(spark, "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def beats(spark, *pairs):
    return spark.createDataFrame([(w, T0 + dt.timedelta(seconds=s)) for w, s in pairs], "worker_id string, ts timestamp")


def test_lease_boundary_batch_equals_stream(spark):
    """A beat exactly one lease later: both forms must agree with each other."""
    b = beats(spark, ("a", 0), ("a", 30), ("a", 61), ("a", 61), ("b", 5))
    far = beats(spark, ("z", 10**8))
    out = scratch(spark, "out")
    sinks.append_sink(live.lease_sessions(files(spark, b, far), "30 seconds", "1 hour"), out, scratch(spark, "cp")).awaitTermination()
    stream = spark.read.parquet(out).filter("worker_id <> 'z'")
    batch = live.lease_intervals(b, 30)
    key = lambda df: sorted(tuple(r) for r in df.select("worker_id", "held_from", "held_until", "beats").collect())
    assert key(stream) == key(batch)


def test_upsert_keeps_newest(spark):
    out = scratch(spark, "out")
    s = live.last_seen(files(spark, beats(spark, ("a", 1), ("b", 1)), beats(spark, ("a", 9)), beats(spark, ("a", 4))))
    sinks.upsert_sink(s, out, scratch(spark, "cp")).awaitTermination()
    got = {r.worker_id: (r.last_seen - T0).seconds for r in sinks.read_latest(spark, out, ["worker_id"]).collect()}
    assert got == {"a": 9, "b": 1}


def test_gap_monitor_across_batches_and_late_numbers(spark):
    mk = lambda *n: spark.createDataFrame([("j", i) for i in n], "job_id string, seq bigint")
    out = scratch(spark, "gaps")
    live.gap_monitor(files(spark, mk(1, 2), mk(5, 6), mk(3, 7), mk(10)), out, scratch(spark, "cp")).awaitTermination()
    got = sorted((r.after_seq, r.before_seq, r.missing) for r in spark.read.parquet(f"{out}/out").collect())
    assert got == [(2, 5, 2), (7, 10, 2)]


def test_restart_continues_where_it_stopped(spark):
    folder, out, cp = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    lines = lambda *n: spark.createDataFrame([(1, i, T0, "x") for i in n], "job_id int, seq int, ts timestamp, line string")
    for part in (lines(1, 2), lines(2, 3)):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        sinks.append_sink(live.ingest_once(stream, "1 day"), out, cp).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_cancel_outcomes(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "failed")], "id int, status string")
    req = spark.range(1, 5).select(F.col("id").cast("int").alias("job_id"))
    got = {r.job_id: r.outcome for r in live.cancel_decisions(req, jobs).collect()}
    assert got == {1: "cancelled", 2: "requested", 3: "conflict", 4: "not found"}


def test_lookups_see_tables_written_between_batches(spark):
    """A job changes hands after the first micro-batch: the old worker's later write is stale, its cancel ends."""
    jobs, out = scratch(spark, "jobs"), scratch(spark, "out")
    schema = "id long, worker_id string, attempt int, status string, cancel_requested boolean"
    spark.createDataFrame([(1, "a", 1, "running", True)], schema).write.parquet(jobs)
    writes = spark.createDataFrame([(1, "a", 1, T0)], "job_id long, worker_id string, attempt int, ts timestamp")
    stream, signals = files(spark, writes, writes), []

    def step(batch):
        now = spark.read.parquet(jobs)
        signals.append(live.cancel_signals(batch, now).count())
        marked = spark.createDataFrame([tuple(r) for r in live.write_outcomes(batch, now).select("job_id", "accepted").collect()], "job_id long, accepted boolean")
        spark.createDataFrame([(1, "b", 2, "succeeded", True)], schema).write.mode("overwrite").parquet(jobs)
        return marked

    sinks.lookup_sink(stream, out, scratch(spark, "cp"), step).awaitTermination()
    got = sorted((r.batch_id, r.accepted) for r in spark.read.parquet(out).collect())
    assert got == [(0, True), (1, False)] and signals == [1, 0]


def test_compaction_keeps_the_current_rows(spark):
    out, to = scratch(spark, "out"), scratch(spark, "compact")
    s = live.last_seen(files(spark, beats(spark, ("a", 1), ("b", 1)), beats(spark, ("a", 9))))
    sinks.upsert_sink(s, out, scratch(spark, "cp")).awaitTermination()
    sinks.compact_latest(spark, out, ["worker_id"], to)
    rows = lambda p: sorted(map(tuple, sinks.read_latest(spark, p, ["worker_id"]).collect()))
    assert rows(to) == rows(out) and spark.read.parquet(to).count() == 2


def test_call_pairs_across_batches_follow_the_batch_rule(spark):
    from tallyframe.operators.usage import pair_calls

    schema = "scope string, call_id int, kind string, ts timestamp, name string, exception boolean"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    one = [("s", 1, "end", at(9), "x", False), ("s", 1, "start", at(0), "old", False), ("s", 2, "start", at(1), "lost", False)]
    two = [("s", 1, "start", at(4), "new", False), ("s", 1, "end", at(12), "x", True), ("s", 1, "start", at(20), "again", False)]
    three = [("s", 1, "end", at(25), "x", False), (None, 1, "end", at(26), "x", False), ("z", 9, "start", at(10**7), "far", False)]
    frames = [spark.createDataFrame(x, schema) for x in (one, two, three)]
    out = scratch(spark, "out")
    stream = live.pair_call_stream(files(spark, *frames), 3600, "1 hour")
    sinks.append_sink(stream, out, scratch(spark, "cp")).awaitTermination()
    key = lambda df: sorted((r.scope, r.call_id, r.name, r.exception, r.latency_seconds) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(pair_calls(frames[0].union(frames[1]).union(frames[2])))


def _folder(spark, rows, schema, path):
    """One file per list of rows, read one file per micro-batch."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_gap_state_over_batches_late_numbers_nulls_and_first_numbers(spark, tmp_path):
    batches = [[("a", 1), ("a", 2), ("b", 7), (None, 3)], [("a", 5), ("a", 5), ("b", 8), (None, 9)], [("a", 3), ("a", 9), ("b", None), ("c", 4)], [("a", 10), ("c", 6)]]
    stream = _folder(spark, batches, "job_id string, seq bigint", str(tmp_path / "in"))
    before = spark.createDataFrame([("b", 4), ("c", 1)], "job_id string, seq bigint")
    out = live.gap_stream(stream, before=before)
    sinks.append_sink(out, str(tmp_path / "out"), str(tmp_path / "state"), rocks=True).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "after_seq", "before_seq", "missing").collect())
    assert got == [("a", 2, 5, 2), ("a", 5, 9, 3), ("b", 4, 7, 2), ("c", 1, 4, 2), ("c", 4, 6, 1)]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_thinned_beats_keep_every_silence():
    import random

    r = random.Random(0)
    for _ in range(300):
        beats = sorted({r.randrange(60) for _ in range(r.randint(1, 25))})
        kept = live._thinned(beats, 7)
        gaps = lambda b: [(x, y) for x, y in zip(b, b[1:]) if y - x > 7]
        assert gaps(kept) == gaps(beats) and kept[0] == beats[0] and kept[-1] == beats[-1]


def test_lost_without_input_and_back_out_of_order(spark, tmp_path):
    """Beats of one worker in mixed order; another falls silent and is told lost by the clock of the others."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[("w", at(10)), ("v", at(0)), ("w", at(0))], [("w", at(25)), ("w", at(100))], [("w", at(130)), ("w", at(105)), (None, at(150))], [("w", at(400))], [(None, at(5000))]]
    stream = _folder(spark, batches, "worker_id string, ts timestamp", str(tmp_path / "in"))
    out = live.liveness_events(stream, 30, "60 seconds")
    sinks.append_sink(out, str(tmp_path / "out"), str(tmp_path / "state"), rocks=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("worker_id", "event", "unix_timestamp(at) - unix_timestamp(timestamp'2024-01-01 00:00:00') as s").collect()
    assert sorted(map(tuple, rows)) == [("v", "lost", 30), ("w", "back", 100), ("w", "back", 400), ("w", "lost", 55), ("w", "lost", 160), ("w", "lost", 430)]


def test_follow_runs_reads_each_file_once_and_only_under_the_root(spark, tmp_path):
    """Odd names come back as they are; drafts, deeper copies and what was read before stay out."""
    from tallyframe.sources import results

    def put(folder, idx):
        place = tmp_path / "ru ns" / folder
        place.mkdir(parents=True, exist_ok=True)
        (place / "results.jsonl").write_text(f'{{"example_idx": {idx}, "score": 1.0, "tokens": {{"input": 2, "output": 3}}}}\n')

    def take():
        rows = results.follow_runs(spark, str(tmp_path / "ru ns") + "/", max_files=1)
        sinks.append_sink(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
        return sorted((r.program, r.version, r.run_number, r.eval_number, r.example_idx) for r in got.collect())

    put("a b/v+1/results/0001/evals/0002", 1)
    put("p%41/v/results/0003/evals/0001", 2)
    put("p/v/results/draft/evals/0001", 3)
    put("p/v/results/00012/evals/0001", 4)
    put("deep/p/v/results/0001/evals/0001", 5)
    want = [("a b", "v+1", 1, 2, 1), ("p%41", "v", 3, 1, 2)]
    assert take() == want and take() == want
    batch = results.read_runs(spark, str(tmp_path / "ru ns"))
    assert sorted((r.program, r.version, r.run_number, r.eval_number, r.example_idx) for r in batch.collect()) == want
    put("None/null/results/0009/evals/9999", 6)
    assert take() == sorted([*want, ("None", "null", 9, 9999, 6)])


def test_counted_sink_tells_accepted_stale_late_and_repeated(spark, tmp_path):
    """The watermark of the batch before last decides what is late; a repeat counts, also one with NULL key parts."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(1, "a", at(100)), (1, "a", at(100)), (None, "a", at(90))], [(2, "b", at(300))], [(None, "a", at(90)), (1, "b", at(85)), (3, "b", at(70))], [(4, "a", at(200)), (5, "a", at(290))]]
    stream = _folder(spark, batches, "id long, w string, ts timestamp", str(tmp_path / "in"))
    owners = lambda b: b.withColumn("accepted", F.col("w") == "a")
    marks = {"accepted": F.col("accepted"), "stale": ~F.col("accepted")}
    query, drops = sinks.counted_sink(stream, str(tmp_path / "c"), str(tmp_path / "state"), owners, marks, "ts", "20 seconds", ["id", "w", "ts"])
    query.awaitTermination()
    drops.wait()
    got = sorted((r.batch_id, r.accepted, r.stale, r.too_late, r.repeated) for r in sinks.read_counts(spark, str(tmp_path / "c")).collect())
    # Late thresholds: none, none, 80 (after batch 0), 280 (after batch 1).
    assert got == [(0, 2, 0, 0, 1), (1, 0, 1, 0, 0), (2, 0, 1, 1, 1), (3, 1, 0, 1, 0)]
    assert spark.read.parquet(str(tmp_path / "c" / "out")).count() == 5


def test_versioned_sink_makes_a_version_per_batch_and_none_for_replays(spark, tmp_path):
    from tallyframe.sources import versions

    root = str(tmp_path / "table")
    batches = [[("a", at, 1) for at in (1, 2)], [("a", 1, 3), ("b", 1, 4)]]
    stream = _folder(spark, batches, "k string, at int, v int", str(tmp_path / "in"))
    for state in ("s1", "s1", "s2"):  # the third start has lost its checkpoint: all batches come again
        sinks.versioned_sink(stream, root, str(tmp_path / state), ["k"], ["at"], name="q").awaitTermination()
    assert sorted(map(tuple, versions.read_version(spark, root).collect())) == [("a", 2, 1), ("b", 1, 4)]
    assert versions.newest(spark, root).version == 1


def test_calls_of_a_bucket_keep_apart_over_batches_and_large_ids_stay_whole(spark):
    """300 calls in 3 buckets, half of each call in a later file, with ids beyond a double and rows without a key beside them."""
    schema = "scope string, call_id bigint, kind string, ts timestamp, name string, exception boolean"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    base = 2**60
    starts = [("s", base + i, "start", at(i), f"n{i}", False) for i in range(300)] + [("s", None, "start", at(5), "x", None), (None, 1, "end", at(7), None, None)]
    ends = [("s", base + i, "end", at(i + 10 + i % 3), None, i % 2 == 0) for i in range(300)]
    far = [("s", None, "end", at(10**6), "far", False)]
    out, frames = scratch(spark, "out"), [spark.createDataFrame(x, schema) for x in (starts, ends, far)]
    sinks.append_sink(live.pair_call_stream(files(spark, *frames), 11, "1 hour", buckets=3), out, scratch(spark, "cp")).awaitTermination()
    got = sorted((r.call_id, r.name, r.exception, r.latency_seconds) for r in spark.read.parquet(out).collect())
    assert got == [(base + i, f"n{i}", i % 2 == 0, 10.0 + i % 3) for i in range(300) if i % 3 < 2]


def test_pairing_calls_a_bucket_once_a_batch_not_once_a_call(spark):
    """The Python function runs per bucket: 2,000 calls in 4 buckets leave at most 4 entries of state, where each call was one."""
    schema = "scope string, call_id bigint, kind string, ts timestamp, name string, exception boolean"
    rows = spark.range(2000).selectExpr("'s' scope", "id call_id", "'start' kind", "timestamp'2001-01-01 00:00:00' ts", "'n' name", "false exception")
    query = sinks.append_sink(live.pair_call_stream(files(spark, rows), 60, "1 hour", buckets=4), scratch(spark, "out"), scratch(spark, "cp"))
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 4


def test_liveness_in_few_buckets_equals_the_silences(spark, tmp_path):
    """Workers of four batches in three buckets, ids beyond a double beside beats of no worker; state is per bucket."""
    import random

    r, base, lease = random.Random(1), 2**60, 30
    beats = sorted({(base + r.randrange(40), r.randrange(2000)) for _ in range(1500)}, key=lambda x: r.random())
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(w, at(s)) for w, s in beats[i::3]] + [(None, at(7))] for i in range(3)] + [[(None, at(10**6))]]
    stream = _folder(spark, batches, "worker_id bigint, ts timestamp", str(tmp_path / "in"))
    query = sinks.append_sink(live.liveness_events(stream, lease, "1 hour", buckets=3), str(tmp_path / "out"), str(tmp_path / "state"), rocks=True)
    query.awaitTermination()
    want = []
    for w in {w for w, _ in beats}:
        times = sorted(s for x, s in beats if x == w)
        for a, b in zip(times, [*times[1:], None]):
            want += [(w, "lost", a + lease)] if b is None or b - a > lease else []
            want += [(w, "back", b)] if b is not None and b - a > lease else []
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("worker_id", "event", "unix_timestamp(at) - unix_timestamp(timestamp'2001-01-01 00:00:00') as s")
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    # Three buckets and what beats without a worker leave, which is nothing.
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3


def test_replayed_files_grow_with_the_table_in_two_batches(spark):
    from tallyframe.checks.check_streams import looked_up, replay

    rows = spark.range(4000).selectExpr("id", "timestamp_seconds(978307200 + id * 60) ts")
    for limit, files in ((500_000, 4), (300, 16)):
        stream, sizes = replay(rows, file_rows=limit), []
        out = looked_up(stream, lambda b: sizes.append(len(set(r[0] for r in b.selectExpr("input_file_name()").distinct().collect()))) or b)
        assert out.selectExpr("count(distinct batch_id)", "count(distinct id)").first() == (2, 4000) and sum(sizes) == files


def test_arrivals_are_written_without_a_shuffle(spark, sf_dir, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tallyframe.checks import check_streams as cs
    from tallyframe.checks.views import Fixtures

    plans, real = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        if "/arrivals-" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    assert cs.l4_counts(Fixtures(spark, sf_dir)).count() > 0
    assert len(plans) == 4 and not any("Exchange" in p for p in plans)


@pytest.mark.parametrize("shape", ["even", "a task without rows of one", "an arrival of one row", "an arrival without rows"])
def test_arrivals_are_one_micro_batch_each(spark, tmp_path, shape):
    from tallyframe.checks.check_streams import arrivals

    number = {
        "even": "id % 3", "a task without rows of one": "case when id < 250 then id % 2 else id % 3 end",
        "an arrival of one row": "case when id = 7 then 1 else id % 2 * 2 end", "an arrival without rows": "id % 2 * 2",
    }[shape]
    df = spark.range(0, 1000, 1, 4).selectExpr("id", f"cast({number} as int) as number")
    seen = {}
    writer = arrivals(df, F.col("number"), 3).writeStream.foreachBatch(lambda b, i: seen.update({i: sorted(map(tuple, b.collect()))}))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted(map(tuple, df.collect()))
    assert seen == {i: [r for r in rows if r[1] == i] for i in range(3)}
