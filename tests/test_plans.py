"""Chunked plans against brute force, with tiny chunks, hot keys, ties and NULLs."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyframe.functions.exprs import digest_order
from tallyframe.plans import ordered
from tallyframe.plans.durable import scratch, shared_dir
from tallyframe.plans.ordered import CHUNK, Running, first_n, hash_chunk, int_chunk, page_of, range_chunks, row_numbers, running
from tallyframe.plans.params import MAX_PARAM_ROWS, param_table
from tallyframe.plans.quantiles import exact_median, exact_quantiles
from tallyframe.plans.running_median import running_median

KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; another key is NULL; some values are NULL."""
    rnd = random.Random(7)
    rows = [("hot", i, None if i % 11 == 0 else rnd.randint(-50, 50)) for i in range(600)]
    rows += [("cold", i, rnd.randint(-50, 50)) for i in range(40)] + [(None, i, i) for i in range(30)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, seq bigint, v bigint").cache()


@pytest.mark.parametrize("before", [False, True])
def test_running_equals_plain_window(hot, before):
    w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    want = hot.select(
        "k", "seq", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("sum"), F.max("v").over(w).alias("max"),
        F.min("v").over(w).alias("min"), F.last("v", True).over(w).alias("last"), F.count(F.lit(1)).over(w).alias("count"),
    )
    for chunk, df in ((int_chunk("seq", 16), hot), (F.col(CHUNK), range_chunks(hot, ["k"], [F.col("seq")], 13))):
        values = [Running(n, n, F.col("v"), before) for n in ("sum", "max", "min", "last")] + [Running("count", "count", None, before)]
        got = running(df, ["k"], [F.col("seq")], chunk, values).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_row_numbers_by_digest(hot):
    d = hot.withColumn("d", digest_order(1, "seq"))
    got = row_numbers(d, ["k"], [F.col("d"), F.col("seq")], "n", hash_chunk(F.col("d"), 2)).select("k", "seq", "n")
    want = d.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("d", "seq"))).select("k", "seq", "n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_row_numbers_over_whole_table(hot):
    got = row_numbers(hot, [], [F.col("v").desc_nulls_last(), F.col("k"), F.col("seq")], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, len(got) + 1))
    by_n = sorted(got, key=lambda r: r.n)
    seen = [r.v for r in by_n if r.v is not None]
    assert seen == sorted(seen, reverse=True)


@pytest.mark.parametrize("n", [3, 1500])
def test_first_n(spark, n):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), "id")
    got = first_n(df, ["k"], [F.col("id").desc()], n)
    want = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.col("id").desc()))).filter(f"r <= {n}").drop("r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_exact_quantiles_at_every_bracket_width(spark):
    """Group sizes around each width's limit, with interpolation and overlapping brackets."""
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 39, 40, 41, 399, 400, 401, 1777, 3999, 4000, 4001, 9999, 10001]
    rows = [(n, float(v)) for n in sizes for v in (rng.normal(size=n) if n % 2 else rng.integers(0, 9, size=n))]
    df = spark.createDataFrame(rows, "n int, v double")
    points = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p97": 0.97, "p99": 0.99, "top": 1.0}
    got = {r.n: r for r in exact_quantiles(df, ["n"], F.col("v"), points).collect()}
    for n in sizes:
        vals = np.array([v for m, v in rows if m == n])
        for name, p in points.items():
            assert got[n][name] == pytest.approx(np.quantile(vals, p), abs=1e-9), (n, name)


def test_pages_of_any_depth(spark):
    df = spark.range(25_000).select((F.col("id") * 7 % 25_000).alias("x"))
    for skip, n in ((0, 5), (9_990, 20), (24_990, 50)):
        got = [r.x for r in page_of(df, [F.col("x").desc()], skip, n).collect()]
        assert got == list(range(24_999 - skip, max(24_999 - skip - n, -1), -1))


def test_exact_median_with_ties_and_nulls(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([0.0, 0.0, 1.5, rnd.random() * 9])) for _ in range(5001)]
    rows += [("pair", 1.0), ("pair", 2.0), ("one", 7.0), ("none", None)] + [("flat", 2.5)] * 100
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], F.col("v"), "m").collect()}
    for k in {r[0] for r in rows}:
        vals = [v for kk, v in rows if kk == k and v is not None]
        assert got[k] == (statistics.median(vals) if vals else None)


@pytest.mark.parametrize("shape", ["spread", "ties"])
def test_exact_quantiles_beyond_the_sketch_size(spark, shape):
    """60,000 rows per group: brackets are in use, and must still give the exact ranks."""
    import numpy as np

    x = F.rand(4) * 100 if shape == "spread" else F.floor(F.rand(4) * 7).cast("double")
    df = spark.range(120_001).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), x.alias("v")).cache()
    points = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99, "top": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], F.col("v"), points, [F.count("v").alias("n")]).collect()}
    for k in ("a", "b"):
        vals = np.array([r.v for r in df.filter(F.col("k") == k).collect()])
        assert got[k].n == len(vals)
        for name, p in points.items():
            assert got[k][name] == pytest.approx(np.quantile(vals, p), abs=1e-9)


@pytest.mark.parametrize("block", [10_000, 32])
def test_running_median(spark, block):
    rnd = random.Random(5)
    rows = [("hot", i, rnd.choice([0.0, 0.0, 2.0, rnd.random()])) for i in range(700)] + [("b", i, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "run string, seq bigint, x double")
    got = {(r.run, r.seq): r.m for r in running_median(df, "run", "seq", "x", "m", block).collect()}
    assert len(got) == len(rows)
    for k in ("hot", "b"):
        xs = [x for r, _, x in rows if r == k]
        for i in range(len(xs)):
            assert got[(k, i)] == pytest.approx(statistics.median(xs[: i + 1]), abs=1e-12)


def test_long_param_tables_are_joined_by_their_size(spark):
    for n, hinted in ((MAX_PARAM_ROWS, True), (MAX_PARAM_ROWS + 1, False)):
        table = param_table(spark, [(f"m{i}", float(i)) for i in range(n)], "m string, p double")
        assert table.count() == n and ("Hint broadcast" in table._jdf.queryExecution().logical().toString()) == hinted


@pytest.fixture
def short_carry(monkeypatch):
    """Carries of at most 500 chunks to a window; what each window would have had to take is noted."""
    seen, real = [], ordered.widest
    monkeypatch.setattr(ordered, "CARRY_ROWS", 500)
    monkeypatch.setattr(ordered, "widest", lambda rows, keys: seen.append(real(rows, keys)) or seen[-1])
    return seen


def test_sparse_numbers_are_carried_in_two_levels(spark, short_carry):
    """Every row its own chunk, one key with most of them, a NULL key; also no key at all."""
    far = F.col("id") * (1 << 19)
    df = spark.range(12_000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "cold").alias("k"), far.alias("seq"),
        F.when(F.col("id") % 7 > 0, (F.col("id") * 37) % 101).alias("v"),
    )
    for keys in (["k"], []):
        w = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        want = df.select(
            "k", "seq", "v", F.count(F.lit(1)).over(w).alias("count"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("sum"),
            F.max("v").over(w).alias("max"), F.last("v", True).over(w).alias("last"),
        )
        values = [Running("count", "count"), *[Running(n, n, F.col("v")) for n in ("sum", "max", "last")]]
        got = running(df, keys, [F.col("seq")], int_chunk("seq"), values, sparse=True)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert short_carry == [9600, 12_000]  # without the second level one window would have taken these


def test_allocation_over_sparse_ids(spark, short_carry):
    from tallyframe.operators.state import allocate

    rnd = random.Random(3)
    rows = [("a" if i % 9 else "b", i << 20, rnd.choice([None, 0, rnd.randrange(5000)])) for i in range(3000)]
    got = {(r.s, r.id): r.run_number for r in allocate(spark.createDataFrame(rows, "s string, id bigint, seed_max bigint"), ["s"]).collect()}
    last = {}
    for s, i, seed in sorted(rows, key=lambda r: r[1]):
        last[s] = max(last.get(s, 0), seed or 0) + 1
        assert got[(s, i)] == last[s]
    assert max(short_carry) > 500


def test_operators_over_sparse_numbers(spark, short_carry):
    from tallyframe.operators.scoring import within_error_budget
    from tallyframe.streaming.live import sequence_gaps

    df = spark.range(2000).select(F.lit("r").alias("run_id"), (F.col("id") * (1 << 20)).alias("seq"), F.when(F.col("id") % 100 == 99, "e").alias("error"))
    assert within_error_budget(df, 3).count() == 400
    gaps = sequence_gaps(df.withColumnRenamed("run_id", "job_id")).agg(F.count("*"), F.min("missing"), F.max("missing")).first()
    assert tuple(gaps) == (1999, (1 << 20) - 1, (1 << 20) - 1)


def test_scratch_uses_the_configured_folder(spark):
    assert scratch(spark, "x").startswith(shared_dir(spark).rstrip("/"))


def test_visits_come_in_bounded_frames():
    import numpy as np
    import pandas as pd

    from tallyframe.operators import neighbors as nb

    rng, cells = np.random.default_rng(0), 40
    vecs, centres = rng.normal(size=(3000, 16)), nb.unit_rows(pd.Series(list(rng.normal(size=(cells, 16)))))
    asks = pd.DataFrame({"id": range(3000), "v": list(vecs)})
    near_cell = np.repeat(np.arange(cells), 3)
    frames = list(nb._visits(iter([asks]), centres, np.arange(cells), np.full(cells, 2.0), near_cell, np.zeros(len(near_cell)), 2))
    assert max(map(len, frames)) <= nb.VISIT_ROWS
    assert len(set(zip(*[pd.concat(frames)[c] for c in ("id", "cell")]))) == 3000 * cells


def test_parent_plan_shuffles_artifacts_once(spark):
    from tallyframe.operators import artifacts as ar

    # (1, 1) twice among the jobs: a parent's attempt counts once.
    jobs = spark.createDataFrame([(1, 1, "compile", None), (1, 1, "compile", None), (2, 1, "eval", 1), (3, 1, "eval", 1)], "id long, attempt long, type string, parent_job_id long")
    arts = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 1, "runner/x"), (2, 1, "b")], "job_id long, attempt long, relative_path string")
    plan = ar.parent_plan(jobs, arts)
    assert sorted((r.eval_id, r.job_id, r.attempt, r.relative_path) for r in plan.collect()) == [(2, 1, 1, "a"), (3, 1, 1, "a")]
    assert "strategy=shuffle_hash" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_keeps_jobs_without_parent_out_of_the_parent_join(spark):
    from tallyframe.operators import jobs as jb

    jobs = spark.createDataFrame([(1, "compile", "ok", None), (2, "eval", "ok", 1), (3, "eval", "bad", 9)], "id long, type string, status string, parent_job_id long")
    out = jb.lineage(jobs)
    got = sorted((r.id, r.parent_job_id, r.parent_type, r.parent_status, r.children, r.latest_child) for r in out.collect())
    assert got == [(1, None, None, None, 1, 2), (2, 1, "compile", "ok", 0, None), (3, 9, None, None, 0, None)]
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_files_grow_in_number(spark, tmp_path):
    from tallyframe.checks.check_examples import _write_lines

    rows = spark.range(1000).selectExpr("id", "cast(id as string) as value")
    for limit, files in ((20_000, 4), (100, 10)):
        path = _write_lines(rows, "id", str(tmp_path / str(limit)), file_lines=limit)
        assert len(list((tmp_path / str(limit)).glob("part-*"))) == files and spark.read.text(path).count() == 1000


def test_artifact_stats_without_expanding_the_groups(spark):
    from tallyframe.operators import artifacts as ar

    rows = [(1, "a", 5), (1, "b", 6), (None, "a", 7), (2, None, None)]
    arts = spark.createDataFrame(rows, "job_id long, kind string, size_bytes long")
    stats = ar.artifact_stats(arts)
    want = [(1, "a", 1, 5), (1, "b", 1, 6), (1, None, 2, 11), (2, None, 1, None), (2, None, 1, None), (None, "a", 1, 7), (None, None, 1, 7), (None, None, 4, 18)]
    assert sorted(map(str, map(tuple, stats.collect()))) == sorted(map(str, want))
    assert ar.artifact_stats(arts.limit(0)).count() == 0
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()
