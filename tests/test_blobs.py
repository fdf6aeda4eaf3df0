"""Objects read from files: listing, pushed bounds, every status."""

import hashlib
import os

from pyspark.sql import functions as F

from tallyframe.operators import storage as so
from tallyframe.sources import blobs

SCHEMA = "name string, recorded_digest string, size_bytes bigint"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def put(root, name, data, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    if at:
        os.utime(path, (at, at))


def test_every_status(spark, tmp_path):
    root = tmp_path / "bl obs"
    files = {"a/ok.bin": b"\x00\xff\x01", "a/empty": b"", "b+c/ch%41nged": b"new", "loose": b"x", "nodigest": b"y", "big/same": b"0" * 50, "big/other": b"1" * 60}
    for name, data in files.items():
        put(root, name, data)
    recorded = spark.createDataFrame(
        [("a/ok.bin", sha(files["a/ok.bin"]), 3), ("a/empty", sha(b""), 0), ("b+c/ch%41nged", sha(b"old"), 3), ("gone", sha(b"x"), 1), (None, sha(b"x"), 1),
         ("nodigest", None, 1), ("big/same", sha(files["big/same"]), 50), ("big/other", sha(b"2"), 1), ("a/ok.bin", sha(b"z"), 3)], SCHEMA,
    )
    found = blobs.digest_objects(spark, str(root), max_bytes=49)
    got = sorted((r.name or "", r.status) for r in so.verify_files(recorded, found).collect())
    assert got == sorted(
        [("a/ok.bin", "intact"), ("a/ok.bin", "changed"), ("a/empty", "unread"), ("b+c/ch%41nged", "changed"), ("gone", "missing"), ("", "missing"),
         ("loose", "unrecorded"), ("nodigest", "unrecorded"), ("big/same", "unread"), ("big/other", "changed")]
    )


def test_listing_feeds_the_orphan_plan_and_bounds_reach_the_scan(spark, tmp_path):
    put(tmp_path, "old", b"1", 1_000_000_000)
    put(tmp_path, "used", b"1", 1_000_000_000)
    put(tmp_path, "new", b"12", 1_000_100_000)
    put(tmp_path, "x.tmp", b"1", 1_000_000_000)
    listing = blobs.list_objects(spark, str(tmp_path))
    used = spark.createDataFrame([("used",)], "name string")
    now = "2001-09-10 12:00:00"  # 1,000,123,200
    assert sorted(r.name for r in so.orphans(listing, used, now).collect()) == ["old", "x.tmp"]
    late = blobs.digest_objects(spark, str(tmp_path), since="2001-09-10 00:00:00")
    assert {r.name: r.computed_digest for r in late.collect()} == {"old": None, "used": None, "x.tmp": None, "new": sha(b"12")}
    setting = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 1000)
        plan = late.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert "LessThanOrEqual(length" in plan and "GreaterThanOrEqual(modificationTime" in plan
    assert [r.name for r in blobs.list_objects(spark, str(tmp_path), "*.tmp").collect()] == ["x.tmp"]


def test_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    found = blobs.digest_objects(spark, str(tmp_path / "none"))
    recorded = spark.createDataFrame([("a", "d", 1)], SCHEMA)
    assert [r.status for r in so.verify_files(recorded, found).collect()] == ["missing"]
    assert so.verify_files(recorded.filter(F.lit(False)), found).count() == 0
