"""Job table queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import row_numbers
from tallyframe.plans.quantiles import exact_quantiles

FILTERS = ("status", "type", "program", "version", "dataset", "split")
STATUSES = ("queued", "running", "succeeded", "failed", "cancelled", "blocked")


def job_view(jobs: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Names for all ids, missing ones NULL.

    ``dims`` maps a name column to a two-column table ``(<name>_id, <name>)``. Adaptive execution
    broadcasts the ones that turn out small; nothing is forced.
    """
    out = jobs
    for name, dim in dims.items():
        out = out.join(dim.select(f"{name}_id", name), f"{name}_id", "left")
    return out


def list_jobs(
    jobs: DataFrame, dims: Mapping[str, DataFrame] | None = None, limit: int = 100, order: str = "created_at", **equal: str
) -> DataFrame:
    """Newest jobs first; equality filters reach the scans, the limit becomes a top-k."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    unknown = set(equal) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = jobs
    for name, value in equal.items():
        if value is None:
            continue
        if dims and name in dims:
            wanted = dims[name].filter(F.col(name) == value).select(f"{name}_id")
            out = out.join(wanted, f"{name}_id", "left_semi")
        else:
            out = out.filter(F.col(name) == value)
    return out.orderBy(F.col(order).desc(), F.col("id").desc()).limit(limit)


def lineage(jobs: DataFrame) -> DataFrame:
    """Every job with its parent's fields and its number of children, both directions in one table.

    Children are counted, not collected: a compile job may have any number of evals.
    """
    parents = jobs.select(
        F.col("id").alias("parent_job_id"), F.col("type").alias("parent_type"), F.col("status").alias("parent_status")
    )
    children = (
        jobs.filter(F.col("parent_job_id").isNotNull())
        .groupBy(F.col("parent_job_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("children"), F.max("id").alias("latest_child"))
    )
    # Jobs without a parent have none to look for; by their NULL they would all meet in one task.
    own = jobs.select("parent_job_id", "id", "type", "status")
    kin = own.filter("parent_job_id is not null").join(parents, "parent_job_id", "left")
    roots = own.filter("parent_job_id is null")
    return (
        kin.unionByName(roots, allowMissingColumns=True)
        .join(children, "id", "left")
        .withColumn("children", F.coalesce("children", F.lit(0)))
    )


def children_of(jobs: DataFrame) -> DataFrame:
    """One row per (parent, child) edge, for callers that list a compile job's evals."""
    child = jobs.filter(F.col("parent_job_id").isNotNull()).select(
        F.col("parent_job_id").alias("id"), F.col("id").alias("child_id"), F.col("status").alias("child_status")
    )
    return jobs.select("id", "type").join(child, "id")


def admit_evals(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Decision per eval request: the parent must exist, be a compile, and have succeeded."""
    parent = jobs.select(F.col("id").alias("parent_job_id"), F.col("type").alias("__t"), F.col("status").alias("__s"))
    reason = (
        F.when(F.col("__t").isNull(), "parent not found")
        .when(F.col("__t") != "compile", "parent is not a compile job")
        .when(F.col("__s") != "succeeded", "parent has not succeeded")
    )
    missing = F.col("__t").isNull() | (F.col("__t") != "compile")
    code = F.when(missing, 404).when(reason.isNotNull(), 409).otherwise(202)
    return requests.join(parent, "parent_job_id", "left").withColumns({"code": code, "reason": reason}).drop("__t", "__s")


def inherit(requests: DataFrame, jobs: DataFrame, columns: Sequence[str], bundle: str | None = None, inherit_from: str = "inherit_bundle_from") -> DataFrame:
    """Child value, else the parent's. The bundle comes from the job named in ``inherit_from`` only."""
    source = jobs.select(F.col("id").alias("parent_job_id"), *[F.col(c).alias(f"__p_{c}") for c in columns])
    out = requests.join(source, "parent_job_id", "left")
    out = out.withColumns({c: F.coalesce(c, f"__p_{c}") for c in columns}).drop(*[f"__p_{c}" for c in columns])
    if bundle:
        donors = jobs.select(F.col("id").alias(inherit_from), F.col(bundle).alias("__b"))
        out = out.join(donors, inherit_from, "left").withColumn(bundle, F.coalesce(bundle, "__b")).drop("__b")
    return out


def default_auto_eval(dataset: Column, split: Column) -> Column:
    return F.concat(F.lit("eval.config."), dataset, F.lit("_"), split, F.lit("-test.yaml"))


def chain_evals(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Queued eval rows for succeeded compile jobs.

    An explicit ``auto_eval_path`` is taken as given; the default name counts only if ``files``
    (``program, version, name``) lists it.
    """
    done = jobs.filter((F.col("type") == "compile") & (F.col("status") == "succeeded"))
    explicit = done.filter(F.col("auto_eval_path").isNotNull()).withColumn("config_name", F.col("auto_eval_path"))
    guessed = done.filter(F.col("auto_eval_path").isNull()).withColumn(
        "config_name", default_auto_eval(F.col("dataset"), F.col("split"))
    )
    found = guessed.join(files.select("program", "version", F.col("name").alias("config_name")), ["program", "version", "config_name"], "left_semi")
    keep = ["repo_id", "user_id", "program", "version", "dataset", "split", "config_name"]
    return explicit.select("id", *keep).unionByName(found.select("id", *keep)).select(
        F.col("id").alias("parent_job_id"), F.lit("eval").alias("type"), F.lit("queued").alias("status"), *keep
    )


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds.isNull(), "-")
        .when(seconds < 60, F.format_string("%ds", seconds))
        .otherwise(F.format_string("%dm%ds", minutes, seconds - minutes * 60))
    )


def durations(jobs: DataFrame, now: str) -> DataFrame:
    """Wait and run seconds; ``now`` (a literal) stands in for the end of running jobs."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    end = F.coalesce(F.col("ended_at").cast("timestamp"), F.lit(now).cast("timestamp"))
    run = F.greatest(F.lit(0), F.round((micros(end) - micros(F.col("started_at"))) / 1e6)).cast("bigint")
    run = F.when(F.col("started_at").isNotNull(), run)
    wait = ((micros(F.col("started_at")) - micros(F.col("created_at"))) / 1e6).cast("bigint")
    return jobs.withColumns({"wait_s": wait, "run_s": run}).withColumn("run_text", duration_text(F.col("run_s")))


def duration_percentiles(timed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact p50/p90/p99 of run time per group, for groups of any size."""
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    stats = [F.count("run_s").alias("jobs"), F.max("run_s").alias("max_s")]
    return exact_quantiles(timed, by, F.col("run_s"), points, stats)


def summary_metrics(jobs: DataFrame, summary: str = "summary") -> DataFrame:
    """Metrics out of the JSON summary of every job; missing or non-numeric -> NULL.

    Optimizer scores of at most 1 are fractions and become percentages.
    """
    v = F.try_parse_json(F.col(summary))
    number = lambda path: F.try_variant_get(v, path, "double")
    as_pct = lambda x: F.when(x <= 1, x * 100).otherwise(x)
    return jobs.withColumns(
        {
            "acc_pct": number("$.acc_pct"),
            "cost_usd": number("$.cost_usd"),
            "rows": F.try_variant_get(v, "$.rows", "bigint"),
            "phase": F.try_variant_get(v, "$.phase", "string"),
            "rows_pct": number("$.eval.rowsPct"),
            "rollouts_pct": number("$.compile.rolloutsPct"),
            "best_pct": as_pct(number("$.compile.bestValset")),
            "front_pct": as_pct(number("$.compile.paretoFront")),
        }
    )


def status_counts(jobs: DataFrame, by: Sequence[str] = ("type", "user_id", "program")) -> DataFrame:
    """Jobs per status (a column each) and group; one aggregate."""
    per = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("jobs"), *per)


def _waiting_reason(running_users: str) -> Column:
    return (
        F.when(F.col("cancel_requested"), "cancel requested")
        .when(F.col("snapshot_id").isNull(), "no snapshot")
        .when(~F.col("allow_parallel_user_jobs") & F.col(running_users).isNotNull(), "user has a running job")
    )


def _with_reason(jobs: DataFrame) -> DataFrame:
    queued = jobs.filter(F.col("status") == "queued")
    # Any running job of the user blocks, parallel ones included.
    busy = durable(jobs.filter(F.col("status") == "running").select("user_id").distinct(), "busy").withColumn("__busy", F.lit(True))
    return queued.join(busy, "user_id", "left").withColumn("reason", _waiting_reason("__busy")).drop("__busy")


def backlog(jobs: DataFrame) -> DataFrame:
    """Queued jobs, runnable or waiting and why, with their place in the user's queue.

    Places come from range chunks over (user, created_at, id), so one user's queue may be any size.
    """
    labelled = _with_reason(jobs).select("user_id", "id", "created_at", "reason")
    out = row_numbers(labelled, ["user_id"], [F.col("created_at"), F.col("id")], "position")
    return out.withColumn("runnable", F.col("reason").isNull())


def next_per_user(jobs: DataFrame) -> DataFrame:
    """First runnable serial job per user: a minimum, so no sort of the queue."""
    ready = _with_reason(jobs).filter(F.col("reason").isNull() & ~F.col("allow_parallel_user_jobs"))
    return ready.groupBy("user_id").agg(F.min(F.struct("created_at", "id")).alias("n")).select("user_id", "n.*")


def serial_violations(jobs: DataFrame) -> DataFrame:
    serial = jobs.filter((F.col("status") == "running") & ~F.col("allow_parallel_user_jobs"))
    return serial.groupBy("user_id").agg(F.count(F.lit(1)).alias("running")).filter("running > 1")


def audit_jobs(jobs: DataFrame, label: str = "run_label") -> DataFrame:
    """Constraint violations ``(rule, scope, n)``."""
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    wrong = jobs.filter((F.col("type") == "eval") != F.col("parent_job_id").isNotNull()).select(
        F.lit("parent iff eval").alias("rule"), text("id").alias("scope"), F.lit(1).cast("bigint").alias("n")
    )

    def repeated(rows: DataFrame, rule: str, scope: Column) -> DataFrame:
        counts = rows.groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return counts.select(F.lit(rule).alias("rule"), "scope", "n")

    compiles, evals = jobs.filter("type = 'compile'"), jobs.filter("type = 'eval'")
    parts = [
        repeated(compiles.filter("emitted_run_number is not null"), "compile number", text("repo_id", "program", "version", "emitted_run_number")),
        repeated(evals.filter("emitted_run_number is not null"), "eval number", text("parent_job_id", "emitted_run_number")),
        repeated(
            compiles.filter("export_run_number is not null"),
            "compile export number",
            text("repo_id", "program", "version", "export_run_number"),
        ),
        repeated(
            evals.filter("export_run_number is not null"), "eval export number", text("parent_job_id", "export_run_number")
        ),
    ]
    if label in jobs.columns:
        parts.append(repeated(jobs, "label", F.col(label)))
    for p in parts:
        wrong = wrong.unionByName(p)
    return wrong


def latest_succeeded(jobs: DataFrame) -> DataFrame:
    """Latest succeeded compile per program version, and the number the next run would get."""
    compiles = jobs.filter("type = 'compile'")
    won = F.when(F.col("status") == "succeeded", F.struct("created_at", "id"))
    out = compiles.groupBy("repo_id", "program", "version").agg(
        F.max(won).alias("__w"), F.max("emitted_run_number").alias("__top")
    )
    return out.select(
        "repo_id", "program", "version", F.col("__w.id").alias("latest_id"), F.col("__w.created_at").alias("latest_at"),
        (F.coalesce("__top", F.lit(0)) + 1).alias("next_number"),
    )
