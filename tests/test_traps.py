"""Hand-made rows for behaviours that are easy to get wrong."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.functions import exprs as xp
from tallyframe.operators import artifacts as ar, examples as ex, jobs as jb, logs as lg, neighbors as nb, scoring as sc, selection as sel
from tallyframe.operators import state as st, storage as so, traces as tr, usage as us
from tallyframe.plans.durable import scratch
from tallyframe.sources import jsonl

RESULT = "run_id string, example_idx bigint, seq bigint, score double, latency double, cost double, tokens_in bigint, tokens_out bigint, error string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def results(spark, *scores):
    data = [("r", i, i, s, 0.1 * i, 0.5, 10, 1, None if s is not None else "boom") for i, s in enumerate(scores)]
    return spark.createDataFrame(data, RESULT)


def lines(spark, text):
    """Written as text files by Spark, read back by the scans under test."""
    path = scratch(spark, "lines")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_two_denominators(spark):
    r = results(spark, 1.0, None, 1.0)
    assert rows(sc.run_summary(r), "rows", "errors") == [(3, 1)]
    assert sc.run_summary(r).first().score_pct == pytest.approx(200 / 3)
    assert rows(sc.eval_summary(r), "rows", "score_pct") == [(2, 100.0)]


def test_failed_rows_pull_latency_down_unless_left_out(spark):
    r = results(spark, 1.0, None, 1.0).withColumn("latency", F.when(F.col("error").isNull(), 1.0).otherwise(0.0))
    assert sc.run_summary(r).first().latency_avg_ms == pytest.approx(2000 / 3)
    assert sc.run_summary(r, ok_only=True).first().latency_avg_ms == pytest.approx(1000)


def test_single_row_has_no_variance(spark):
    assert sc.run_summary(results(spark, 1.0)).first().latency_var_ms2 is None


def test_resume_ignores_copies_and_missing_index(spark):
    r = results(spark, 1.0, 0.0)
    again = r.union(r).union(r.withColumn("example_idx", F.lit(None).cast("bigint")))
    assert rows(sc.load_completed(again), "completed", "score_sum", "tokens_in") == [(2, 1.0, 20)]
    todo = spark.createDataFrame([("r", 0), ("r", 5), ("q", 0)], "run_id string, example_idx bigint")
    assert rows(sc.remaining(todo, again), "run_id", "example_idx") == [("q", 0), ("r", 5)]


def test_metric_failure_zeroes_the_row(spark):
    df = spark.createDataFrame([(1, 0.7, 5, None), (2, 0.7, 5, "late")], "row_idx int, cost double, tokens_in bigint, error string")
    out = sc.score(df, F.lit(1.0), F.when(F.col("row_idx") == 1, "metric broke"))
    assert rows(out, "row_idx", "score", "cost", "tokens_in", "error") == [(1, 0.0, 0.0, 0, "metric broke"), (2, 0.0, 0.0, 0, "late")]


def test_default_feedback_prints_floats_as_python(spark):
    values = [0.0, 1.0, 0.5, 1e-4, 1e-5, 1.25e-7, 123456789.0, 1e16, 1.5e22, -3e-9, 0.00012]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(sc.float_text(F.col("v"))).collect()]
    assert got == [str(v) for v in values]


def test_split_keeps_order_and_repeats_and_raises(spark):
    e = spark.range(5).select(F.col("id").alias("row_idx"), (F.col("id") * 10).alias("x"))
    m = spark.createDataFrame([("d", {"train": [3, 1, 3], "val": [], "test": [9]})], "source string, splits map<string,array<bigint>>")
    s = ex.manifest_rows(m)
    assert [r.x for r in ex.select_split(e, s, "train").orderBy("pos").collect()] == [30, 10, 30]
    assert [r.x for r in ex.select_split(e, s, "train", limit=2).orderBy("pos").collect()] == [30, 10]
    assert ex.select_split(e, s, "val").count() == 0
    with pytest.raises(ValueError):
        ex.select_split(e, s, "dev")
    with pytest.raises(PySparkException):
        ex.select_split(e, s, "test").collect()


def test_split_audit_sees_non_integers(spark):
    s = spark.createDataFrame([("train", "1"), ("train", "x"), ("val", "1"), ("train", "2.5")], "split string, row_idx string")
    got = rows(ex.audit_splits(s, spark.range(3).withColumnRenamed("id", "row_idx")), "reason", "split", "row_idx")
    assert got == [("not_an_integer", "train", "2.5"), ("not_an_integer", "train", "x"), ("overlap", "train+val", "1")]


def test_key_presence_not_null(spark):
    raw = ['{"input":{"q":null}}', '{"input":null}', '{"input":{"z":1},"q":2}', '{"input":[1]}', '{"input":{}}']
    df = spark.createDataFrame(list(enumerate(raw)), "row_idx int, s string").withColumn("record", F.parse_json("s"))
    got = {r.row_idx: (r.q, r.n) for r in ex.shape_examples(df, ["q"], strict=False).select("row_idx", F.to_json("q").alias("q"), F.size("missing").alias("n")).collect()}
    assert got == {0: ("null", 0), 1: ("null", 0), 2: ("2", 0), 3: ("[1]", 0), 4: (None, 1)}
    with pytest.raises(PySparkException, match="missing declared inputs: q"):
        ex.shape_examples(df, ["q"]).collect()


def test_two_inputs_do_not_take_a_scalar(spark):
    df = spark.createDataFrame([(0, '{"input":"s","a":1}')], "row_idx int, s string").withColumn("record", F.parse_json("s"))
    out = ex.shape_examples(df, ["a", "b"], strict=False).select(F.to_json("a").alias("a"), "missing").first()
    assert (out.a, out.missing) == ("1", ["b"])


def test_read_examples_numbers_non_blank_lines(spark):
    path = lines(spark, '{"a":1}\n\n  \n{"a":2}\r{"a":3}\n')
    got = rows(jsonl.read_examples(spark, path).select("row_idx", F.variant_get("record", "$.a", "int").alias("a")), "row_idx", "a")
    assert got == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        jsonl.read_examples(spark, lines(spark, '{"a":1}\n{broken')).select(F.to_json("record")).collect()


def test_read_examples_across_file_splits(spark):
    """Small splits: positions must continue across them."""
    path = scratch(spark, "many")
    spark.range(5000).select(F.format_string('{"n":%d,"pad":"%s"}', "id", F.repeat(F.lit("x"), 50)).alias("value")).coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = jsonl.read_examples(spark, path).select("row_idx", F.variant_get("record", "$.n", "bigint").alias("n"))
        assert df.rdd.getNumPartitions() > 5
        assert df.filter("row_idx <> n").count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tolerant_results(spark):
    path = lines(spark, '{"score":true}\n{"score":"0.5"}\n{"score":1}\nnull\n[]\n{"x":1}\n{bad')
    assert rows(jsonl.read_results(spark, path), "score") == [(1.0,), (1.0,)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        jsonl.read_results(spark, path, tolerant=False).collect()


def test_reported_cost_zero_or_negative_falls_back(spark):
    u = spark.createDataFrame(
        [(1, "m", 1000000, 0, 0.0), (2, "m", 1000000, 0, -1.0), (3, "m", 1000000, 0, 0.3), (4, "x/m", 5, 5, None), (5, "m", None, None, None)],
        "id int, model string, prompt_tokens bigint, completion_tokens bigint, cost double",
    )
    prices = us.price_dim(spark, {"m": {"input": 2.0, "output": 1.0}, "x": {"m": {"input": 1.0}}, "_meta": {"input": 1, "output": 1}})
    assert rows(us.with_cost(u, prices), "id", "model_cost") == [(1, 2.0), (2, 2.0), (3, 0.3), (4, 0.0), (5, 0.0)]
    assert rows(us.unpriced(u.withColumn("total_tokens", F.lit(7)), prices), "model", "rows", "total_tokens") == [("x/m", 1, 7)]


def test_call_pairing_reuse_repeats_and_orphans(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2001, 1, 1) + dt.timedelta(seconds=s)
    data = [(1, "start", 0), (1, "end", 2), (1, "start", 5), (1, "end", 9), (1, "end", 10)]  # id used twice, one end too many
    data += [(2, "start", 0), (2, "start", 3), (2, "end", 4), (3, "end", 1), (4, "start", 1), (5, "end", 7), (5, "start", 7), (None, "start", 0), (None, "end", 1)]
    ev = spark.createDataFrame([(0, c, k, at(s), "m", False) for c, k, s in data], "scope int, call_id int, kind string, ts timestamp, name string, exception boolean")
    assert rows(us.pair_calls(ev), "call_id", "latency_seconds") == [(1, 2.0), (1, 4.0), (2, 1.0), (5, 0.0)]
    none = us.lm_latency(us.pair_calls(ev.limit(0))).first()
    assert (none.calls, none.total_seconds, none.mean_seconds) == (0, 0.0, 0.0)


def test_dimension_chain_keeps_rows_with_null_keys(spark):
    f = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "p string, v string")
    dims, facts = st.upsert_dims(f, [("program", ["p"]), ("version", ["v"])])
    assert rows(facts, "p", "v", "program_id", "version_id") == sorted([("a", "x", 1, 1), ("a", None, 1, None), (None, "x", None, None), ("b", "x", 2, 2)], key=repr)
    again, _ = st.upsert_dims(f.union(spark.createDataFrame([("c", "x")], f.schema)), [("program", ["p"]), ("version", ["v"])], dims)
    assert rows(again["program"], "p", "program_id") == [("a", 1), ("b", 2), ("c", 3)]


def test_first_maximum_wins_and_stops_at_perfect(spark):
    a = spark.createDataFrame(
        [(0, "p", 1, "a", 0.5, ""), (0, "p", 2, "b", 0.5, ""), (0, "p", 3, "c", 0.4, ""), (1, "p", 1, "a", 1.0, ""), (1, "p", 2, "b", 2.0, "")],
        "example_idx bigint, pred_name string, attempt bigint, instruction string, score double, feedback string",
    )
    assert rows(sel.best_attempts(a), "example_idx", "final_instruction", "num_attempts", "achieved_perfect") == [(0, "a", 3, False), (1, "a", 1, True)]
    assert rows(sel.best_attempts(a, max_retries=1), "example_idx", "num_attempts") == [(0, 1), (1, 1)]


def test_grid_merges_and_rejects():
    ok, bad = sel.expand_grid({"model": ["a", "b"], "k": [1, 2]}, [{"name": "n", "k": 9}, {"model": None, "strategy": "z"}], {"k": 0, "strategy": "s"})
    assert [(r["model"], r["k"]) for r in ok] == [("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 0)]
    assert [(r["_name"], r["missing"]) for r in bad] == [("n", ["model"])]
    assert sel.expand_grid({}, None, {"model": "m"}) == ([], [])


def test_minibatches_small_and_empty_pools(spark):
    routed = spark.range(23).select(F.col("id").alias("row_idx"), F.when(F.col("id") < 20, "big").when(F.col("id") < 22, "tiny").alias("route"))
    got = sel.minibatches(routed, 6, seed=1, epochs=2)
    per = {(r.route, r.epoch, r.batch): r.n for r in got.groupBy("route", "epoch", "batch").agg(F.count("*").alias("n")).collect()}
    assert per == {**{("big", e, b): 6 for e in (0, 1) for b in range(3)}, ("tiny", 0, 0): 2, ("tiny", 1, 0): 2}
    assert got.filter("route = 'big'").groupBy("epoch").agg(F.count_distinct("row_idx").alias("n")).filter("n <> 18").count() == 0
    it = sel.iteration_batches(routed, ["big", "tiny", "none"], 6, 11, seed=1)
    sizes = {r.iteration: (r.route, r.n) for r in it.groupBy("iteration", "route").agg(F.count("*").alias("n")).collect()}
    assert sizes == {i: (("big", 6), ("tiny", 2), ("none", 6))[i % 3] for i in range(11)}
    assert rows(it.filter("route = 'none'").select("row_idx").distinct(), "row_idx") == [(i,) for i in range(6)]


def test_unknown_route_lists_known():
    sel.register_route("known", [("key", "part")])
    with pytest.raises(ValueError, match="known"):
        sel.named_route("nope")


def test_a_component_listed_twice_takes_its_turns_from_one_pool(spark):
    routed = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(24)], "row_idx int, route string")
    it = sel.iteration_batches(routed, ["a", "b", "a"], 2, 9, seed=1)
    got = {r.iteration: r.route for r in it.select("iteration", "route").distinct().collect()}
    assert got == {i: "aba"[i % 3] for i in range(9)}
    ids = [r.row_idx for r in it.filter("route = 'a'").collect()]
    assert len(ids) == 12 and len(set(ids)) == 12


def test_majority_tie_takes_smallest(spark):
    p = spark.createDataFrame([(0, 1, 5), (1, 1, 3), (2, 2, 9)], "candidate int, row_idx int, pred int")
    assert rows(sel.majority(p), "row_idx", "answer", "votes") == [(1, 3, 1), (2, 9, 1)]


def test_knn_blocks_agree_with_one_block(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(120, 8))
    vecs[60:80] = vecs[0]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    one = rows(nb.knn_demos(df, df, 4, skip_same_id=True), "query_id", "rank", "neighbor_id")
    many = rows(nb.knn_demos(df, df, 4, block_rows=17, skip_same_id=True), "query_id", "rank", "neighbor_id")
    pruned = rows(nb.knn_demos(df, df, 4, block_rows=5, pivots=20, skip_same_id=True), "query_id", "rank", "neighbor_id")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    want = []
    for q in range(120):
        near = sorted((-sim[q, t], t) for t in range(120) if t != q)[:4]
        want += [(q, i + 1, t) for i, (_, t) in enumerate(near)]
    assert one == many == pruned == sorted(want, key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_knn_on_clusters_copies_and_zero_vectors(spark, k):
    """Clustered vectors make the pruning bite; queries and training rows overlap only partly."""
    import numpy as np

    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 5)) * 4
    vecs = np.concatenate([c + rng.normal(size=(30, 5)) * 0.05 for c in centres] + [np.tile(centres[0], (20, 1)), np.zeros((2, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    q, t = df.filter("vec_id < 120 or vec_id >= 200"), df.filter("vec_id >= 40")
    got = rows(nb.knn_demos(q, t, k, block_rows=16, pivots=8, skip_same_id=True), "query_id", "rank", "neighbor_id")
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
    sim = np.round(unit @ unit.T, 6)
    want = []
    for a in [i for i in range(len(vecs)) if i < 120 or i >= 200]:
        near = sorted((-sim[a, b], b) for b in range(40, len(vecs)) if b != a)[:k]
        want += [(a, i + 1, b) for i, (_, b) in enumerate(near)]
    assert got == sorted(want, key=repr)
    asks, points = (x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")) for x in (q, t))
    _placed, visits, _sizes = nb._prune(asks, points, k, 8)
    if k < 50:
        assert visits.count() < q.count() * 8 / 2  # most cells are ruled out


def test_holdout_survives_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "row_idx")
    a = rows(sel.holdout(df.repartition(1), 0.2, 3), "row_idx", "part")
    assert a == rows(sel.holdout(df.repartition(17), 0.2, 3), "row_idx", "part")
    with pytest.raises(ValueError):
        sel.holdout(df, 1.5)


JOBS = (
    "id bigint, type string, status string, user_id string, worker_id string, lease_expires_at timestamp, cancel_requested boolean, "
    "allow_parallel_user_jobs boolean, snapshot_id bigint, created_at timestamp, runtime_spec string, parent_job_id bigint"
)


def jobs(spark, *data):
    base = dict(type="compile", status="queued", user_id="u", cancel_requested=False, allow_parallel_user_jobs=False, snapshot_id=1, runtime_spec="")
    names = [c.split()[0] for c in JOBS.split(", ")]
    return spark.createDataFrame([tuple({**base, "id": i, **d}.get(n) for n in names) for i, d in enumerate(data)], JOBS)


def test_backlog_counts_any_running_job_serial_check_only_serial(spark):
    j = jobs(
        spark, {"status": "running", "allow_parallel_user_jobs": True}, {}, {"allow_parallel_user_jobs": True}, {"user_id": "v"},
        {"user_id": "v", "cancel_requested": True}, {"user_id": "w", "snapshot_id": None},
    )
    assert rows(jb.backlog(j), "id", "reason") == [
        (1, "user has a running job"), (2, None), (3, None), (4, "cancel requested"), (5, "no snapshot")
    ]
    assert rows(jb.next_per_user(j), "user_id", "id") == [("v", 3)]
    assert jb.serial_violations(j).count() == 0


def test_reclaim_follows_not_in(spark):
    import datetime as dt

    now = "2001-01-01 00:01:00"
    late, soon = dt.datetime(2001, 1, 1, 0, 0, 0), dt.datetime(2001, 1, 2)
    j = jobs(
        spark,
        {"status": "running", "worker_id": "a", "lease_expires_at": soon},
        {"status": "running", "worker_id": None, "lease_expires_at": soon},
        {"status": "running", "worker_id": "b", "lease_expires_at": soon, "cancel_requested": True},
        {"status": "running", "worker_id": "a", "lease_expires_at": late},
        {"status": "running", "worker_id": "a", "lease_expires_at": None},
    )
    hb = spark.createDataFrame([("a", dt.datetime(2001, 1, 1, 0, 0, 50))], "worker_id string, ts timestamp")
    assert rows(so.reclaim_plan(j, hb, now), "id", "new_status") == [(2, "cancelled"), (3, "queued")]
    none = rows(so.reclaim_plan(j, hb.limit(0), now), "id")
    assert none == [(i,) for i in range(5)]  # nobody live: a missing worker is lost too


def test_admission(spark):
    j = jobs(spark, {"status": "succeeded"}, {"status": "failed"}, {"type": "eval", "status": "succeeded"})
    req = spark.createDataFrame([(i, p) for i, p in enumerate([0, 1, 2, 99])], "r int, parent_job_id bigint")
    assert rows(jb.admit_evals(req, j), "r", "code") == [(0, 202), (1, 409), (2, 404), (3, 404)]


def test_job_list_limits(spark):
    j = jobs(spark, {}, {})
    for bad in (0, 501):
        with pytest.raises(ValueError):
            jb.list_jobs(j, limit=bad)
    with pytest.raises(ValueError):
        jb.list_jobs(j, colour="x")


def test_versions(spark):
    specs = {">=0.1,<0.2": True, "==0.1": False, ">0.1": True, "": True, " >=0.1.5 , ": True, "~=1": False, "<0.1.10": True, None: True}
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    assert {r.s: r.ok for r in df.select("s", xp.compatible("s", "0.1.5").alias("ok")).collect()} == specs


def test_identity_and_names(spark):
    df = spark.createDataFrame([(None, " \t", "x/.bashrc"), (" a ", "b", "x/y.tar.gz"), ("c" * 300, None, "plain")], "a string, b string, p string")
    got = df.select(xp.pick_identity("a", "b"), xp.base_stem("p")).collect()
    assert [(r[0], r[1]) for r in got] == [("anonymous", ".bashrc"), ("a", "y.tar"), ("c" * 256, "plain")]


def test_media_url_matches_urllib(spark):
    from urllib.parse import quote

    p = "a b*~é/c+d%/e&f"
    df = spark.createDataFrame([(p,)], "p string")
    want = "https://h/x/" + "/".join(quote(s, safe="") for s in p.split("/"))
    assert df.select(xp.media_url("p", "https://h/x/")).first()[0] == want


def test_percent_modes(spark):
    df = spark.createDataFrame([(0, 5), (1, 0), (1, 3)], "c int, t int")
    assert [tuple(r) for r in df.select(xp.pct("c", "t"), xp.pct("c", "t", "rows")).collect()] == [(None, 0.0), (None, 0.0), (33.3, 33.3)]


def test_export_number_zero_counts_as_missing(spark):
    j = spark.createDataFrame(
        [(1, "compile", "p", "v", None, 0, 7, 1), (2, "compile", "p", "v", None, 12345, 7, 1), (3, "eval", "p", "v", 1, 3, 9, 1)],
        "id bigint, type string, program string, version string, parent_job_id bigint, export_run_number int, emitted_run_number int, attempt int",
    )
    a = spark.createDataFrame([(i, 1, "f") for i in (1, 2, 3)] + [(1, 0, "old"), (1, 1, "runner/x")], "job_id bigint, attempt int, relative_path string")
    assert rows(ar.export_plan(j, a, "out"), "id", "job_id", "destination") == [
        (1, 1, "out/p/v/results/0007/f"), (2, 2, "out/p/v/results/12345/f"), (3, 1, "out/p/v/results/0007/f"), (3, 3, "out/p/v/results/0007/f")
    ]


def test_classifiers_differ(spark):
    paths = ["runner/stdout.log", "runner/x", "results.jsonl", "a/results.jsonl", "x.yaml", "a/x.yaml", "compile/program.py", "deep/program.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", ar.classify("p"), ar.classify("p", "import")).collect()}
    assert got == {
        "runner/stdout.log": ("stdout_log", "other"), "runner/x": ("other", "other"), "results.jsonl": ("other", "other"),
        "a/results.jsonl": ("results_jsonl", "other"), "x.yaml": ("config", "config"), "a/x.yaml": ("other", "other"),
        "compile/program.py": ("program_py", "program_py"), "deep/program.py": ("program_py", "other"),
    }


def test_renames_pair_one_to_one(spark):
    a = spark.createDataFrame([(f"base/o{i}", "same") for i in range(40)] + [("base/k", "k"), ("top", "t")], "path string, digest string")
    b = spark.createDataFrame([(f"base/n{i}", "same") for i in range(30)] + [("base/k", "z"), ("top", "t")], "path string, digest string")
    got = ar.diff_manifests(a, b, ["base"])
    per = {r.status: r.n for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert per == {"renamed": 30, "deleted": 10, "modified": 1, "unchanged": 1}
    assert got.filter("old_path is not null").select("old_path").distinct().count() == 30


def test_exclude_rules(spark):
    paths = ["tests/a", "x/tests/a", "a/results/b", "a/results", "results.txt", "m/x.pyc", "data/big/z", "database/z"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in so.scope(df, ["/tests/", "**/results/", "*.pyc"], ["data/big"]).collect()]
    assert got == ["x/tests/a", "results.txt", "database/z"]


def test_path_audit_reasons(spark):
    paths = ["/abs", "a\\..\\b", "base/p/v/results/1", "base/p/ok", "base", "other", "nul\x00"]
    df = spark.createDataFrame([(p, True) for p in paths] + [("base/dir", False)], "path string, is_regular boolean")
    assert {r.path: r.reason for r in ar.audit_paths(df, ["base"]).collect()} == {
        "/abs": "absolute path", "a\\..\\b": "parent segment", "base/p/v/results/1": "results path", "base/p/ok": None, "base": None,
        "other": "outside roots", "nul\x00": "null byte", "base/dir": "not a regular file",
    }


def test_digest_ignores_order_and_partitions_but_not_copies(spark):
    df = spark.createDataFrame([(i % 50, f"t{i % 50}") for i in range(400)], "id int, t string")
    d = lambda x: so.dataset_digest(x, "id", ["t"]).first()[0]
    assert d(df.repartition(1)) == d(df.orderBy(F.desc("t")).repartition(17))
    assert d(df) != d(df.limit(399)) and len(d(df)) == 64


def test_insert_twice_is_insert_once(spark):
    b = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "k int, v string, o int")
    once = st.insert_new(None, b, ["k"], ["o"])
    assert rows(once, "k", "v") == rows(st.insert_new(once, b, ["k"], ["o"]), "k", "v") == [(1, "b"), (2, "c")]


def test_numbers_rise_and_skip_seeds(spark):
    r = spark.createDataFrame([("p", i, s) for i, s in enumerate([0, 0, 10, 3, 0, 40, 0])] + [("q", 9, None)], "s string, id bigint, seed_max int")
    want = [("p", i, n) for i, n in enumerate([1, 2, 11, 12, 13, 41, 42])] + [("q", 9, 1)]
    assert rows(st.allocate(r, ["s"]), "s", "id", "run_number") == want
    assert rows(st.allocate(r, ["s"], chunk=F.floor(F.col("id") / 2)), "s", "id", "run_number") == want


def test_label_is_at_most_forty(spark):
    import hashlib

    stem = "--Repo_eval " + "x" * 60
    df = spark.createDataFrame([(stem,)], "s string")
    label = df.select(st.run_label("s")).first()[0]
    assert label == ("repo_eval-" + "x" * 60)[:33] + "_" + hashlib.sha1(stem.encode()).hexdigest()[:6] and len(label) == 40


OBS = "trace_id int, obs_id int, parent_id int, start_s int"


def test_tree_orphans_cycles_flat_and_deep(spark):
    data = [(1, 1, None, 5), (1, 2, 1, 9), (1, 3, 1, 7), (1, 4, 2, 0), (1, 5, 77, 0), (1, 6, 7, 0), (1, 7, 6, 0)]
    data += [(2, 1, 9, 3), (2, 2, 1, 1)]
    data += [(3, i, i - 1 if i else None, 0) for i in range(70)]
    got = {(r.trace_id, r.obs_id): (r.depth, r.position) for r in tr.trace_tree(spark.createDataFrame(data, OBS)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): (0, 1), (1, 3): (1, 2), (1, 2): (1, 3), (1, 4): (2, 4)}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 2): (0, 1), (2, 1): (0, 2)}
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, i): (i, i + 1) for i in range(70)}


def test_trace_paging(spark):
    t = spark.range(25).select(F.col("id").alias("trace_id"), F.lit("e").alias("environment"), (F.col("id") % 5).alias("timestamp"), F.when(F.col("id") > 0, F.repeat(F.lit("y"), 141)).alias("input"))
    seen = [r.trace_id for p in (1, 2, 3) for r in tr.trace_page(t, "e", p, 10).orderBy(F.desc("timestamp"), "trace_id").collect()]
    assert sorted(seen) == list(range(25)) and seen[:2] == [4, 9]
    first = {r.trace_id: (r.total_items, r.total_pages, r.preview) for r in tr.trace_page(t, "e", 3, 10).collect()}
    assert first[0] == (25, 3, "") and first[5][2] == "y" * 140 + "…"
    with pytest.raises(ValueError):
        tr.trace_page(t, "e", 1, 201)
    with pytest.raises(ValueError):
        tr.sample_traces(t, 1.1)


LOG = "job_id int, seq int, line string"


def test_phase_texts_and_override(spark):
    df = spark.createDataFrame(
        [(1, 1, "Compilation complete"), (2, 1, "=== eval start"), (3, 1, "Evaluation Complete"), (3, 2, "Results saved to x"), (4, 1, "  "), (5, 1, "Saved results")], LOG
    )
    assert rows(lg.phase(df), "job_id", "phase") == [(1, "compile-done"), (2, "eval"), (3, "compile"), (4, "unknown"), (5, "done")]
    assert rows(lg.phase(df.filter("job_id = 3"), eval_done="Evaluation Complete|Results saved to"), "phase") == [("done",)]


def test_status_needs_latency_numbers_and_allows_no_variance(spark):
    ok = "[3/10] Acc: 66.7% | Tokens: 1,234 (in:1,000/out:234) | Cost: $0.0120 | Latency: avg=10ms, med=9ms | ETA: 1.5m"
    df = spark.createDataFrame([(1, 1, ok), (1, 2, ok.replace("avg=10ms, med=9ms", "N/A")), (1, 3, ok + " " + ok.replace("[3/", "[4/"))], LOG)
    assert rows(lg.parse_status(df), "seq", "rows_done", "tokens_total", "var_ms2", "eta")[0] == (1, 3, 1234, None, "1.5m")
    assert lg.latest_status(df).select("rows_done", "cost_per_1k_rows").first()[:] == (4, 3.0)


def test_progress_bar_prefers_rollouts(spark):
    df = spark.createDataFrame([(1, 1, "0/9 [00:01<?, ?rollouts/s]"), (1, 2, "load 5/7 [0:00:01<00:02, 2.5it/s]"), (2, 1, "text")], LOG)
    got = lg.optimizer_progress(df).collect()
    assert [(r.job_id, r.rollouts_cur, r.rollouts_total, r.rollouts_pct, r.rate) for r in got] == [(1, 0, 9, None, "?rollouts/s")]


def test_errors_cut_and_counted(spark):
    df = spark.createDataFrame([(1, 1, "x ERROR a"), (1, 2, "Traceback (most " + "z" * 300)], LOG)
    r = lg.log_errors(df).first()
    assert (r.errors, len(r.last_error)) == (2, 240)


def test_metric_forms(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x")], "gold int, prediction string")
    for metric in (
        lambda ex, pred: float(int(pred) == ex["gold"]),
        lambda ex, pred, trace=None: int(pred) == ex["gold"],
        lambda gold, pred, trace, name, name_trace: {"score": int(pred) == gold["gold"]},
    ):
        out = sc.score(df, sc.python_metric(metric)(F.struct("gold"), "prediction"))
        got = out.orderBy("gold").collect()
        assert [r.score for r in got] == [1.0, 0.0] and got[0].error is None and "invalid literal" in got[1].error
    traced = sc.python_metric(lambda ex, pred, trace=None: len(trace or ""))
    assert [r.score for r in sc.score(df, traced(F.struct("gold"), "prediction", F.lit("abc"))).collect()] == [3.0, 3.0]
    with pytest.raises(TypeError):
        sc.python_metric(lambda ex: 1)


def _tree(data):
    """Depth and position by recursion over children, on (trace, obs, parent, start)."""
    out = {}
    for t in {r[0] for r in data}:
        mine = [r for r in data if r[0] == t]
        rooted = any(r[2] is None for r in mine)
        children = {}
        for _, o, up, s in mine:
            children.setdefault(up if rooted else None, []).append((s, o))
        stack, n = [(o, 0) for _, o in sorted(children.get(None, []), reverse=True)], 0
        while stack:
            o, d = stack.pop()
            n += 1
            out[(t, o)] = (d, n)
            stack += [(c, d + 1) for _, c in sorted(children.get(o, []), reverse=True)] if rooted else []
    return out


@pytest.mark.parametrize("chunks", [1, 7])
def test_tours_over_chunks_rings_and_missing_parents(spark, chunks):
    import random

    r = random.Random(chunks)
    data = []
    for t in ("a", "b", "c"):
        for i in range(60):
            data.append((t, f"o{i}", None if i < 2 else f"o{r.randrange(i)}", r.randrange(5)))
    data += [("a", "x1", "x2", 1), ("a", "x2", "x3", 1), ("a", "x3", "x1", 1), ("a", "y", "nowhere", 1), ("a", "y2", "y", 1)]
    data += [("flat", f"o{i}", "gone", i % 3) for i in range(20)] + [("chain", f"n{i:04d}", f"n{i - 1:04d}" if i else None, 0) for i in range(300)]
    df = spark.createDataFrame(data, "trace_id string, obs_id string, parent_id string, start_s int")
    got = {(x.trace_id, x.obs_id): (x.depth, x.position) for x in tr.trace_tree(df, chunks=chunks).collect()}
    assert got == _tree(data)


def test_a_chain_100000_deep(spark):
    """Rows hold one pointer and two sums whatever the depth; numeric ids beyond what a double holds stay exact."""
    n, base = 100_000, 1 << 60
    df = spark.range(n).select(F.lit(1).alias("trace_id"), (F.col("id") + base).alias("obs_id"), F.when(F.col("id") > 0, F.col("id") + base - 1).alias("parent_id"), F.lit(0).alias("start_s"))
    out = tr.trace_tree(df, chunks=5)
    wrong = out.filter((F.col("depth") != F.col("obs_id") - base) | (F.col("position") != F.col("depth") + 1))
    assert out.count() == n and wrong.count() == 0
