"""Content addressing, retention and liveness sweeps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.exprs import compatible
from tallyframe.plans.durable import durable

LIVE_SECONDS = 30
STALE_SECONDS = 300
# Line ends, as text editors see them.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def retention_plan(snapshots: DataFrame, jobs: DataFrame, now: str, grace_hours: int = 24) -> DataFrame:
    """``(kind, key)`` to delete: manifests no job uses and older than the grace period, then every
    snapshot or out-of-band blob that no surviving manifest shares. A plan only, so a dry run is the
    same call."""
    used = jobs.filter(F.col("snapshot_id").isNotNull()).select("snapshot_id").distinct()
    old = F.col("created_at").cast("timestamp") < _at(now) - F.expr(f"interval {int(grace_hours)} hours")
    marked = snapshots.join(used.withColumn("__used", F.lit(True)), "snapshot_id", "left").withColumn(
        "__drop", F.col("__used").isNull() & old
    )

    def blobs(kind: str, digest: str) -> DataFrame:
        per = marked.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.bool_and("__drop").alias("__all"))
        return per.filter("__all").select(F.lit(kind).alias("kind"), F.col(digest).alias("key"))

    manifests = marked.filter("__drop").select(F.lit("manifest").alias("kind"), F.col("snapshot_id").cast("string").alias("key"))
    return manifests.unionByName(blobs("snapshot_blob", "digest")).unionByName(blobs("oob_blob", "oob_digest"))


def orphans(objects: DataFrame, references: DataFrame, now: str, grace_hours: int = 24, name: str = "name") -> DataFrame:
    """Objects nothing references, unmodified since the cutoff (or with no modification time)."""
    cutoff = _at(now) - F.expr(f"interval {int(grace_hours)} hours")
    refs = references.filter(F.col(name).isNotNull()).select(name)
    loose = objects.join(refs, name, "left_anti")
    return loose.filter(F.col("modified_at").isNull() | (F.col("modified_at").cast("timestamp") < cutoff))


def live_workers(heartbeats: DataFrame, now: str, seconds: int = LIVE_SECONDS) -> DataFrame:
    """Latest heartbeat per worker and whether it is recent enough."""
    latest = heartbeats.groupBy("worker_id").agg(F.max("ts").alias("last_seen"))
    fresh = F.col("last_seen").cast("timestamp") > _at(now) - F.expr(f"interval {int(seconds)} seconds")
    return latest.withColumn("live", fresh)


def reclaim_plan(jobs: DataFrame, heartbeats: DataFrame, now: str, seconds: int = LIVE_SECONDS) -> DataFrame:
    """Running jobs whose lease ran out or whose worker is not live, and what becomes of them.

    SQL ``NOT IN`` rules: a job without a worker counts as lost only when no worker is live at all.
    Spelled as an equi-join plus one scalar, because a null-aware anti join inside OR would be a
    nested loop.
    """
    live = durable(live_workers(heartbeats, now, seconds).filter("live").select("worker_id"), "live").withColumn("__live", F.lit(True))
    any_live = live.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    running = jobs.filter("status = 'running'").join(live, "worker_id", "left").withColumn("__any", any_live)
    lost = F.when(~F.col("__any"), True).when(F.col("worker_id").isNull(), False).otherwise(F.col("__live").isNull())
    expired = F.coalesce(F.col("lease_expires_at").cast("timestamp") < _at(now), F.lit(False))
    return running.filter(expired | lost).select(
        "id", "worker_id", F.when(F.col("cancel_requested"), "cancelled").otherwise("queued").alias("new_status")
    )


def stale_queue(jobs: DataFrame, now: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """Queued jobs without a snapshot past the grace period fail with a reason."""
    old = F.col("created_at").cast("timestamp") < _at(now) - F.expr(f"interval {int(seconds)} seconds")
    rows = jobs.filter((F.col("status") == "queued") & F.col("snapshot_id").isNull() & old)
    return rows.select("id", F.lit("failed").alias("new_status"), F.lit("queued_without_snapshot").alias("error"))


def block_plan(jobs: DataFrame, snapshots: DataFrame, available: DataFrame, version: str, spec: str = "runtime_spec") -> DataFrame:
    """Running jobs that cannot proceed and the first reason why. ``available`` lists fetchable digests."""
    snaps = snapshots.select("snapshot_id", F.col("digest").alias("__digest"))
    have = durable(available.select(F.col("digest").alias("__digest")).distinct(), "available").withColumn("__have", F.lit(True))
    joined = jobs.filter("status = 'running'").join(snaps, "snapshot_id", "left").join(have, "__digest", "left")
    reason = (
        F.when(F.col("snapshot_id").isNull(), "job has no snapshot")
        .when(F.col("__digest").isNull(), "snapshot has no digest")
        .when(F.col("__have").isNull(), "snapshot unavailable")
        .when(~compatible(spec, version), "runtime incompatible")
    )
    return joined.select("id", "snapshot_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def unblock_plan(jobs: DataFrame, snapshots: DataFrame, available: DataFrame) -> DataFrame:
    """Blocked jobs, of any repo, whose snapshot's digest has become available."""
    ready = snapshots.join(available.select("digest"), "digest", "left_semi").select("snapshot_id")
    blocked = jobs.filter("status = 'blocked'").join(ready, "snapshot_id", "left_semi")
    return blocked.select("id", F.lit("queued").alias("new_status"))


def verify_digests(blobs: DataFrame, content: str = "content", recorded: str = "recorded_digest") -> DataFrame:
    computed = F.sha2(F.col(content).cast("binary"), 256)
    return blobs.withColumn("computed_digest", computed).withColumn("intact", F.col("computed_digest") == F.col(recorded))


def verify_files(recorded: DataFrame, found: DataFrame, name: str = "name", digest: str = "recorded_digest") -> DataFrame:
    """Recorded objects (``name, recorded_digest, size_bytes``) against ``blobs.digest_objects``, one row for each of both.

    ``status``: ``intact``; ``changed`` (another digest, or another size where the file was not read); ``unread`` (not read, size
    as recorded or not recorded); ``missing`` (no file, also with a NULL name); ``unrecorded`` (no record, or one without a digest). A name
    recorded twice is judged twice. File scans pass over files of 0 bytes, so a record of no bytes without a file is ``unread``, not missing.
    """
    left = recorded.select(F.col(name).alias("__n"), F.col(digest).alias("recorded_digest"), F.col("size_bytes").alias("__size"))
    both = left.join(found, F.col("__n") == F.col("name"), "full")
    status = (
        F.when(F.col("name").isNull(), F.when((F.col("__size") == 0) & F.col("__n").isNotNull(), "unread").otherwise("missing"))
        .when(F.col("recorded_digest").isNull(), "unrecorded")
        .when(F.col("computed_digest") == F.col("recorded_digest"), "intact")
        .when(F.col("computed_digest").isNotNull() | (F.col("__size") != F.col("size_bytes")), "changed")
        .otherwise("unread")
    )
    return both.select(
        F.coalesce("name", "__n").alias("name"), "size_bytes", "modified_at", "recorded_digest", "computed_digest", status.alias("status")
    )


def dataset_digest(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One SHA-256 for a whole table, whatever its row order or partitioning.

    Row digests collapse copies to a count, then fold along digest prefixes of 6, 4, 2 and 0 hex
    digits: every list hashed is a small sorted slice, never the table.
    """
    value = lambda c: F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("null"))
    row = F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[value(c) for c in cols]), 256)
    level = df.groupBy(row.alias("prefix")).agg(F.count(F.lit(1)).alias("__n"))
    level = level.select("prefix", F.concat_ws(":", "prefix", "__n").alias("entry"))
    for digits in (6, 4, 2, 0):
        level = level.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ","), 256).alias("__h")
        ).select("prefix", F.concat_ws(":", "prefix", "__h").alias("entry"))
    return level.select(F.substring("entry", 2, 64).alias("digest"))


def dedupe_stats(manifests: DataFrame, by: Sequence[str] = (), digest: str = "digest", size: str = "size_bytes") -> DataFrame:
    """Manifests, distinct contents and bytes saved; counts per digest are combined map-side first."""
    per = manifests.groupBy(*by, digest).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__all"), F.max(size).alias("__one")
    )
    out = per.groupBy(*by).agg(
        F.sum("__n").alias("manifests"),
        F.count(F.lit(1)).alias("contents"),
        F.sum("__all").alias("bytes"),
        F.sum(F.col("__all") - F.col("__one")).alias("bytes_saved"),
    )
    return out.withColumn("dedupe_ratio", F.col("manifests") / F.col("contents"))


def resolve(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``(repo_id, digest)`` to the first snapshot id, or ``missing``."""
    ids = durable(snapshots.groupBy("repo_id", "digest").agg(F.min("snapshot_id").alias("snapshot_id")), "ids")
    return requests.join(ids, ["repo_id", "digest"], "left").withColumn("missing", F.col("snapshot_id").isNull())


# What a glob's marks match; any other character matches itself. ``*`` also crosses ``/``.
_GLOB = re.compile(r"(?P<any>\*+)|(?P<one>\?)|\[(?P<not>!)?(?P<set>[^\]]+)\]|(?P<same>.)", re.S)


def _glob(pattern: str) -> str:
    def of(m: re.Match) -> str:
        if m["any"]:
            return ".*"
        if m["one"]:
            return "."
        return f"[{'^' if m['not'] else ''}{m['set']}]" if m["set"] else re.escape(m["same"])

    return _GLOB.sub(of, pattern)


def rule_regex(excludes: Sequence[str], out_of_band: Sequence[str] = ()) -> str | None:
    """One anchored expression for all rules; None without rules.

    Three kinds of rules: roots (``/x/`` and out-of-band ones) cover a path and all below it, names (``x``, ``**/x/``)
    any path segment, and every rule that is not a root also the whole path as a glob.
    """
    rules = [r.strip() for r in excludes]
    roots = {r.strip("/") for r in rules if r.startswith("/")} | {o.strip("/") for o in out_of_band}
    rest = {r for r in rules if r and not r.startswith("/")}
    names = {r.replace("**/", "").strip("/") for r in rest}
    whole = rest | {r.rstrip("/") for r in rest}
    parts = [f"{re.escape(r)}(?:/.*)?" for r in sorted(roots - {""})]
    parts += [f"(?:.*/)?{re.escape(n)}(?:/.*)?" for n in sorted(names - {""}) if "/" not in n]
    parts += [_glob(w) for w in sorted(whole - {""})]
    return rf"(?s)\A(?:{'|'.join(parts)})\z" if parts else None


def excluded(path: str | Column, excludes: Sequence[str], out_of_band: Sequence[str] = ()) -> Column:
    """Does a path fall under an exclude rule? See ``rule_regex``; the rules are matched in one pass."""
    rule = rule_regex(excludes, out_of_band)
    return (F.col(path) if isinstance(path, str) else path).rlike(rule) if rule else F.lit(False)


def scope(df: DataFrame, excludes: Sequence[str], out_of_band: Sequence[str] = (), path: str = "path") -> DataFrame:
    return df.filter(~excluded(path, excludes, out_of_band))


def seed_state(df: DataFrame, roots: Sequence[str], path: str = "path") -> DataFrame:
    """Largest four-digit results number per program version, from paths the snapshot leaves out."""
    alternatives = "|".join(re.escape(r.strip("/")) for r in sorted(roots, key=len, reverse=True))
    rx = rf"\A(?:{alternatives})/([^/]+)/([^/]+)/results/(\d{{4}})(?:/|\z)"
    got = df.select(*[F.regexp_extract(path, rx, i).alias(n) for i, n in ((1, "program"), (2, "version"), (3, "__n"))])
    return got.filter("__n <> ''").groupBy("program", "version").agg(F.max(F.col("__n").cast("bigint")).alias("seed_max"))


def scan_literals(docs: DataFrame, needles: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)`` for every line that contains any needle; documents without one are
    dropped before their lines are split."""
    rx = "|".join(re.escape(n) for n in needles if n)
    lines = docs.filter(F.col(text).rlike(rx)).select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("__pos", "__line"))
    hits = lines.filter(F.col("__line").rlike(rx))
    return hits.select(
        key, (F.col("__pos") + 1).cast("bigint").alias("line_no"), F.regexp_replace("__line", r"^\s+|\s+\z", "").alias("line")
    )
