"""Tables that change by commit records: replays, killed writes, nulls, ties, types."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.durable import scratch
from tallyframe.sources import versions as vs

SCHEMA = "k string, n int, at int, v string"


def rows(df):
    return sorted(df.collect(), key=repr)


def make(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_upsert_versions_and_replays(spark):
    root = scratch(spark, "vt")
    one = make(spark, ("a", 1, 5, "x"), ("a", 1, 3, "old"), (None, 1, 1, "null"), ("b", None, 2, "y"))
    two = make(spark, ("a", 1, 4, "late"), (None, 1, 2, "newer"), ("c", 3, 1, "z"))
    assert vs.apply_batch(one, root, ["k", "n"], ["at"], writer="q", batch_id=0, buckets=4)
    assert vs.apply_batch(two, root, ["k", "n"], ["at"], writer="q", batch_id=1)
    first = {("a", 1, 5, "x"), (None, 1, 1, "null"), ("b", None, 2, "y")}
    second = {("a", 1, 5, "x"), (None, 1, 2, "newer"), ("b", None, 2, "y"), ("c", 3, 1, "z")}
    assert {tuple(r) for r in rows(vs.read_version(spark, root))} == second
    assert {tuple(r) for r in rows(vs.read_version(spark, root, 0))} == first
    for again in (0, 1):  # replays: no new version
        assert not vs.apply_batch(one, root, ["k", "n"], ["at"], writer="q", batch_id=again)
    assert vs.newest(spark, root).version == 1
    assert vs.apply_batch(one, root, ["k", "n"], ["at"], writer="other", batch_id=0)  # another writer's numbers are its own
    assert {tuple(r) for r in rows(vs.read_version(spark, root))} == second


def test_insert_does_nothing_on_conflict_over_many_batches(spark):
    root = scratch(spark, "vt")
    want = {}
    for i in range(vs.MAX_FOLDERS + 3):  # past the point where a bucket is written anew
        part = [(f"k{j}", None if j == 0 else j, i, f"{i}-{j}") for j in range(i % 3, i + 2)] + [(None, 0, i, f"n{i}")]
        for k, n, at, v in part:
            want.setdefault((k, n), (at, v))
        assert vs.apply_batch(make(spark, *part, part[0]), root, ["k", "n"], ["at"], keep="first", batch_id=i, buckets=2)
    got = {(r.k, r.n): (r["at"], r.v) for r in vs.read_version(spark, root).collect()}
    assert got == want and vs.read_version(spark, root).count() == len(want)
    folders = [p.bucket for p in vs.newest(spark, root).parts]
    assert max(folders.count(b) for b in folders) <= vs.MAX_FOLDERS


def test_killed_write_leaves_the_version_before(spark, monkeypatch):
    root = scratch(spark, "vt")
    vs.apply_batch(make(spark, ("a", 1, 1, "x")), root, ["k"], ["at"], batch_id=0)
    two = make(spark, ("a", 1, 2, "y"), ("b", 1, 1, "z"))
    real, calls = vs.newest, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:  # data folders are written, the record is not
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(vs, "newest", dies)
    with pytest.raises(KeyboardInterrupt):
        vs.apply_batch(two, root, ["k"], ["at"], batch_id=1)
    monkeypatch.setattr(vs, "newest", real)
    assert rows(vs.read_version(spark, root)) == rows(make(spark, ("a", 1, 1, "x")))
    assert vs.apply_batch(two, root, ["k"], ["at"], batch_id=1)
    assert rows(vs.read_version(spark, root)) == rows(two)


def test_second_writer_is_noticed(spark, monkeypatch):
    root = scratch(spark, "vt")
    vs.apply_batch(make(spark, ("a", 1, 1, "x")), root, ["k"], ["at"])
    stale = vs.newest(spark, root)
    vs.apply_batch(make(spark, ("b", 1, 1, "x")), root, ["k"], ["at"])
    real, first = vs.newest, [True]
    monkeypatch.setattr(vs, "newest", lambda *a: stale if first and first.pop() else real(*a))
    with pytest.raises(RuntimeError, match="another writer"):
        vs.apply_batch(make(spark, ("c", 1, 1, "x")), root, ["k"], ["at"])


def test_empty_batches_ties_and_wider_types(spark):
    root = scratch(spark, "vt")
    assert vs.apply_batch(make(spark).limit(0), root, ["n"], ["at"], keep="first", batch_id=0)
    assert vs.read_version(spark, root).count() == 0
    wide = make(spark, ("b", 7, 1, "y"), ("a", 7, 1, "x")).withColumn("n", F.col("n").cast("long")).withColumn("extra", F.lit(1))
    assert vs.apply_batch(wide, root, ["n"], ["at"], keep="first", batch_id=1)
    assert vs.apply_batch(make(spark, ("c", 7, 0, "w")), root, ["n"], ["at"], keep="first", batch_id=2)
    assert rows(vs.read_version(spark, root)) == rows(make(spark, ("a", 7, 1, "x")))
    with pytest.raises(ValueError):
        vs.read_version(spark, root, 9)
    with pytest.raises(ValueError):
        vs.read_version(spark, scratch(spark, "none"))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_a_batch_is_shuffled_once_and_written_once(spark, monkeypatch, keep):
    from pyspark.sql.readwriter import DataFrameWriter

    root, plans, real = scratch(spark, "vt"), [], DataFrameWriter.parquet
    vs.apply_batch(make(spark, ("a", 1, 5, "x"), ("b", 1, 5, "x")), root, ["k"], ["at"], keep=keep)

    def noted(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    vs.apply_batch(make(spark, ("a", 1, 6, "y"), ("c", 1, 6, "y")), root, ["k"], ["at"], keep=keep)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1
    a = ("a", 1, 5, "x") if keep == "first" else ("a", 1, 6, "y")
    assert rows(vs.read_version(spark, root)) == rows(make(spark, a, ("b", 1, 5, "x"), ("c", 1, 6, "y")))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_busy_keys_and_tasks_of_few_rows_against_plain_python(spark, monkeypatch, keep):
    """One key holds most rows (NULL another part of them), -0.0 is 0.0, buckets are spread over many tasks."""
    monkeypatch.setattr(vs, "TASK_ROWS", 50)
    root, want, pick = scratch(spark, "vt"), {}, min if keep == "first" else max
    for i in range(3):
        data = [("hot", 0.0 if j % 2 else -0.0, (j * 7919 + i) % 10_007, str(j)) for j in range(3000)]
        data += [(None, 1.0, j % 900, f"n{i}") for j in range(1500)] + [(f"k{j}", float(j), i, "v") for j in range(i * 100, 400)]
        seen = {}
        for k, n, at, v in data:
            seen[k, n] = pick(seen.get((k, n), (at, v)), (at, v))
        for key, row in seen.items():
            want[key] = want.get(key, row) if keep == "first" else max(want.get(key, row), row)
        batch = spark.createDataFrame(data, "k string, n double, at int, v string")
        assert vs.apply_batch(batch, root, ["k", "n"], ["at"], keep=keep, batch_id=i, buckets=8)
    got = vs.read_version(spark, root).collect()
    assert len(got) == len(want) and {(r.k, r.n): (r["at"], r.v) for r in got} == want


def test_a_batch_with_other_keys_on_each_reading_is_refused(spark):
    import random

    root = scratch(spark, "vt")
    vs.apply_batch(make(spark, ("a", 1, 1, "x")), root, ["k"], ["at"], buckets=4096)
    drawn = F.udf(lambda _: str(random.getrandbits(60)), "string").asNondeterministic()
    batch = spark.range(20).select(drawn("id").alias("k"), F.lit(1).alias("n"), F.lit(1).alias("at"), F.lit("v").alias("v"))
    with pytest.raises(Exception, match="read again"):
        vs.apply_batch(batch, root, ["k"], ["at"])
    assert rows(vs.read_version(spark, root)) == rows(make(spark, ("a", 1, 1, "x")))
