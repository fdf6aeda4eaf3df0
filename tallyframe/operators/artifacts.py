"""Artifact tables: current attempt, kinds, plans, path audit, diffs, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.exprs import any_prefix, run_no
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import hash_chunk, row_numbers

# Directory the runner keeps its own files in; change it to match the layout in use.
RUNNER_DIR = "runner/"
# Places a compiled program may lie in.
_COMPILED = (
    "compiled_program/program.pkl",
    "deploy/compiled_program/program.pkl",
    "compile/compiled_program/program.pkl",
)


def _current(arts: DataFrame, jobs: DataFrame) -> DataFrame:
    now = jobs.select(F.col("id").alias("job_id"), "attempt")
    return arts.join(now, ["job_id", "attempt"], "left_semi")


def artifacts_for(jobs: DataFrame, arts: DataFrame, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows of each job's current attempt, by job and path; filters apply before the join."""
    if prefix:
        arts = arts.filter(F.startswith("relative_path", F.lit(prefix)))
    if kind:
        arts = arts.filter(F.col("kind") == kind)
    return _current(arts, jobs).orderBy("job_id", "relative_path")


def classify(path: str | Column, rules: str = "worker", runner_dir: str = RUNNER_DIR) -> Column:
    """Artifact kind; the first rule that fits decides. The kind names and the places they stand for."""
    p = F.col(path) if isinstance(path, str) else path
    at_root = ~F.contains(p, F.lit("/"))
    ends = lambda s: F.endswith(p, F.lit(s))
    starts = lambda s: F.startswith(p, F.lit(s))
    common = [
        (ends(".yaml") & at_root, "config"),
        (any_prefix(p, _COMPILED), "compiled_program"),
        (starts("gepa_logs/"), "gepa_log"),
    ]
    if rules == "worker":
        chain = [
            (starts(runner_dir) & ends("stdout.log"), "stdout_log"),
            (starts(runner_dir), "other"),
            (p == "program.hash", "program_hash"),
            (p == "EVAL_SUMMARY.md", "eval_summary_md"),
            *common,
            (ends("/results.jsonl"), "results_jsonl"),
            (ends("/metrics.py"), "metrics_py"),
            (ends("/program.py"), "program_py"),
        ]
    elif rules == "import":
        chain = [(p == "program.hash", "program_hash"), *common, (starts("compile/program.py"), "program_py")]
    else:
        raise ValueError(f"unknown rule set {rules!r}")
    out = F.when(*_pair(chain[0]))
    for item in chain[1:]:
        out = out.when(*_pair(item))
    return out.otherwise("other")


def _pair(rule: tuple[Column, str]) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[1])


def include(df: DataFrame, prefixes: Sequence[str], root_files: Sequence[str] = (), path: str = "relative_path") -> DataFrame:
    return df.filter(any_prefix(path, prefixes) | F.col(path).isin(*root_files))


def parent_plan(jobs: DataFrame, arts: DataFrame, runner_dir: str = RUNNER_DIR) -> DataFrame:
    """Files an eval needs from its parent: the parent's current attempt without the runner's own files.

    Evals meet their parents' attempts first, so the wide artifact rows are shuffled once, and hashed against
    the narrow side instead of sorted.
    """
    evals = jobs.filter("type = 'eval'").select(F.col("id").alias("eval_id"), F.col("parent_job_id").alias("job_id"))
    now = jobs.select(F.col("id").alias("job_id"), "attempt").distinct()
    needed = evals.join(now, "job_id")
    return arts.filter(~F.startswith("relative_path", F.lit(runner_dir))).join(needed.hint("shuffle_hash"), ["job_id", "attempt"])


def export_plan(jobs: DataFrame, arts: DataFrame, root: str, runner_dir: str = RUNNER_DIR) -> DataFrame:
    """Files and destinations per exported job; an eval brings its parent's files along.

    The directory number is the compile job's export number, or its emitted one when that is 0 or NULL.
    """
    number = F.coalesce(F.nullif("export_run_number", F.lit(0)), F.col("emitted_run_number"))
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), "program", "version", F.lit("results"), run_no(number))
    homes = jobs.filter("type = 'compile'").select(F.col("id").alias("home_id"), folder.alias("folder"))
    compiles = jobs.filter("type = 'compile'").select("id", F.col("id").alias("home_id"), F.col("id").alias("job_id"))
    evals = jobs.filter("type = 'eval'")
    own = evals.select("id", F.col("parent_job_id").alias("home_id"), F.col("id").alias("job_id"))
    inherited = evals.select("id", F.col("parent_job_id").alias("home_id"), F.col("parent_job_id").alias("job_id"))
    plan = compiles.unionByName(own).unionByName(inherited).join(homes, "home_id")
    usable = _current(arts.filter(~F.startswith("relative_path", F.lit(runner_dir))), jobs)
    return plan.join(usable, "job_id").withColumn("destination", F.concat_ws("/", "folder", "relative_path"))


def is_results_path(path: str | Column, roots: Sequence[str]) -> Column:
    """``<root>/<program>/<version>/results/...`` under any root."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        rest = F.split(F.substr(p, F.lit(len(r) + 2)), "/")
        out = out | (F.startswith(p, F.lit(r + "/")) & (F.coalesce(F.get(rest, 2), F.lit("")) == "results"))
    return out


def under_roots(path: str | Column, roots: Sequence[str]) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for r in roots:
        out = out | (p == r.rstrip("/")) | F.startswith(p, F.lit(r.rstrip("/") + "/"))
    return out


def audit_paths(df: DataFrame, roots: Sequence[str], path: str = "path", regular: str = "is_regular") -> DataFrame:
    """First reason a path is unsafe or skipped; NULL means acceptable."""
    p = F.col(path)
    segments = F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/")
    reason = (
        F.when(~F.col(regular), "not a regular file")
        .when(F.startswith(p, F.lit("/")), "absolute path")
        .when(F.contains(p, F.lit("\x00")), "null byte")
        .when(F.array_contains(segments, ".."), "parent segment")
        .when(~under_roots(p, roots), "outside roots")
        .when(is_results_path(p, roots), "results path")
    )
    return df.withColumn("reason", reason)


def artifact_stats(arts: DataFrame, by: Sequence[str] = ("job_id", "kind")) -> DataFrame:
    """Files and bytes per group with subtotals; the finest groups are summed once.

    Each level is summed from the one below, so a task holds the groups of one level at a time, not all levels of every group.
    """
    level = arts.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    out = level
    for n in reversed(range(len(by))):
        level = level.groupBy(*by[:n]).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        # A total of no rows at all is no group.
        out = out.unionByName(level.filter("files is not null"), allowMissingColumns=True)
    return out


def diff_manifests(before: DataFrame, after: DataFrame, roots: Sequence[str], path: str = "path", digest: str = "digest") -> DataFrame:
    """``(path, status, old_path, verdict)`` between two manifests.

    A deletion and an addition with equal content pair up as a rename, one to one: each side is
    numbered inside its digest, so many copies of one content never multiply.
    """
    a = before.select(F.col(path).alias("path"), F.col(digest).alias("__a"))
    b = after.select(F.col(path).alias("path"), F.col(digest).alias("__b"))
    both = a.join(b, "path", "full_outer").withColumn(
        "status",
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "deleted")
        .when(F.col("__a") != F.col("__b"), "modified")
        .otherwise("unchanged"),
    )
    key = F.md5(F.col("path").cast("binary"))
    changed = durable(
        both.filter(F.col("status").isin("added", "deleted")).select(
            "path", "status", F.coalesce("__a", "__b").alias("__d"), key.alias("__key")
        )
    )
    numbered = row_numbers(
        changed, ["status", "__d"], [F.col("__key"), F.col("path")], "__n", hash_chunk(F.col("__key"))
    )
    side = lambda s: F.max(F.when(F.col("status") == s, F.col("path")))
    pairs = numbered.groupBy("__d", "__n").agg(side("added").alias("new_path"), side("deleted").alias("old_path")).select(
        F.coalesce("new_path", "old_path").alias("path"),
        F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("status"),
        F.when(F.col("new_path").isNotNull(), F.col("old_path")).alias("old_path"),
    )
    kept = both.filter(F.col("status").isin("modified", "unchanged")).select(
        "path", "status", F.lit(None).cast("string").alias("old_path")
    )
    inside = under_roots("path", roots)
    verdict = (
        F.when(F.col("status") == "unchanged", "none")
        .when(is_results_path("path", roots), "ignored")
        .when(~inside, "rejected: outside overlay roots")
        .when(F.col("status").isin("deleted", "renamed"), "rejected: deletion or rename")
        .otherwise("included")
    )
    return kept.unionByName(pairs).withColumn("verdict", verdict)


def merge_layers(layers: DataFrame, path: str = "path", layer: str = "layer") -> DataFrame:
    """One row per path, from the uppermost (lowest-numbered) layer."""
    rest = [c for c in layers.columns if c != path]
    return layers.groupBy(path).agg(F.min_by(F.struct(*rest), F.col(layer)).alias("__r")).select(path, "__r.*")
