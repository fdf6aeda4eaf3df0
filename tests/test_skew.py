"""With broadcasts off, a key with a third of the rows must be split by adaptive execution."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import artifacts as ar, jobs as jb, scoring as sc, storage as so

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(n=400_000, keys=5000):
    i = F.col("id")
    return F.when(i % 3 == 0, 0).otherwise(i % keys).cast("bigint")


def splits(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.toString().count("skew=true")


def test_hot_job_in_artifacts(skew):
    arts = skew.range(400_000).select(hot().alias("job_id"), F.lit(1).alias("attempt"), F.md5(F.col("id").cast("string")).alias("relative_path"))
    jobs = skew.range(5000).select("id", F.lit(1).alias("attempt"))
    assert splits(ar.artifacts_for(jobs, arts))


def test_hot_parent_in_admission(skew):
    jobs = skew.range(5000).select("id", F.lit("compile").alias("type"), F.lit("succeeded").alias("status"))
    req = skew.range(400_000).select(F.md5(F.col("id").cast("string")).alias("request"), hot().alias("parent_job_id"))
    assert splits(jb.admit_evals(req, jobs))


def test_hot_copy_in_distinct_scoring(skew):
    docs = skew.range(400_000).select(hot().alias("text"), F.md5(F.col("id").cast("string")).alias("pad"))
    out = sc.score_distinct(docs, ["text"], lambda d: d.withColumn("s", F.col("text") * 2))
    assert splits(out)
    assert out.count() == 400_000


def test_hot_digest_in_resolve(skew):
    req = skew.range(400_000).select(F.lit("r").alias("repo_id"), hot().cast("string").alias("digest"), F.md5(F.col("id").cast("string")).alias("pad"))
    snaps = skew.range(5000).select(F.col("id").alias("snapshot_id"), F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("digest"))
    out = so.resolve(req, snaps)
    assert splits(out)
    assert out.filter("missing").count() == 0


def test_hot_worker_in_reclaim(skew):
    worker = F.concat(F.lit("w"), hot().cast("string"))
    jobs = skew.range(400_000).select(
        "id", F.lit("running").alias("status"), worker.alias("worker_id"), F.lit(None).cast("timestamp").alias("lease_expires_at"),
        (F.length(F.md5(F.col("id").cast("string"))) > 99).alias("cancel_requested"),
    )
    beats = skew.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("worker_id"), F.lit(dt.datetime(2001, 1, 1)).alias("ts"))
    out = so.reclaim_plan(jobs, beats.filter("worker_id <> 'w0'"), "2001-01-01 00:00:10")
    assert out.count() == 400_000 // 3 + 1 + len([i for i in range(400_000) if i % 3 and i % 5000 == 0])


def test_hot_run_in_summary(skew):
    i = F.col("id")
    r = skew.range(400_000).select(
        hot().cast("string").alias("run_id"), (i % 2).cast("double").alias("score"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1e3).alias("latency"),
        F.lit(0.1).alias("cost"), F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"), F.lit(None).cast("string").alias("error"),
    ).cache()
    got = sc.run_summary(r).filter("run_id = '0'").first()
    want = r.filter("run_id = '0'").agg(F.median("latency") * 1000).first()[0]
    assert got.latency_med_ms == pytest.approx(want)


def test_running_spreads_a_hot_key_of_already_partitioned_input(skew):
    """Input hashed by the key alone must be redistributed by (key, chunk)."""
    from tallyframe.plans.ordered import Running, int_chunk, running

    df = skew.range(200_000).select(F.lit(7).alias("k"), F.col("id").alias("seq")).repartition(16, "k")
    out = running(df, ["k"], [F.col("seq")], int_chunk("seq", 10_000), [Running("n", "count")])
    skew.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.filter("n <> seq + 1").count() == 0
    skew.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 100_000
