"""State resolution: keys, upserts, fenced writes, numbering, merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyframe.plans import ordered
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import int_chunk, prior_totals, row_numbers


def upsert_dim(existing: DataFrame | None, facts: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Dimension with unseen keys added; new ids follow the largest one in use, in key order.

    Keys with a NULL part get no row.
    """
    seen = facts.select(*keys).dropna().distinct()
    if existing is None:
        return row_numbers(seen, [], [F.col(k) for k in keys], id_col)
    fresh = seen.join(existing, list(keys), "left_anti")
    numbered = row_numbers(fresh, [], [F.col(k) for k in keys], "__rn")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    new = numbered.select(*keys, (top + F.col("__rn")).alias(id_col))
    return existing.select(*keys, id_col).unionByName(new)


def upsert_dims(
    facts: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], existing: Mapping[str, DataFrame] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Insert-if-absent down a chain of levels; each level is keyed by its parent's id.

    ``levels``: ``(name, own key columns)`` from top to bottom. Returns the dimension tables and
    the facts with every ``<name>_id`` (NULL where a key is NULL). All levels are resolved on the distinct key tuples,
    which are read from the facts once, and joined back once.
    """
    dims: dict[str, DataFrame] = {}
    all_keys = list(dict.fromkeys(c for _, own in levels for c in own))
    out, parent = durable(facts.select(*all_keys).distinct(), "keys"), []
    for name, own in levels:
        keys = [*parent, *own]
        dims[name] = upsert_dim((existing or {}).get(name), out, keys, f"{name}_id")
        out = out.join(dims[name], keys, "left")
        parent = [f"{name}_id"]
    ids = [f"{name}_id" for name, _ in levels]
    tuples = out.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(all_keys)], *ids)
    same = F.lit(True)
    for i, k in enumerate(all_keys):
        same = same & facts[k].eqNullSafe(F.col(f"__{i}"))
    return dims, facts.join(tuples, same, "left").select(facts["*"], *ids)


def insert_new(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert, doing nothing on conflict; inside the batch the first row in ``order`` wins.

    Copies collapse map-side, so a key repeated a billion times costs one row per task.
    """
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
    if target is None:
        return first
    return target.unionByName(first.join(target, list(keys), "left_anti").select(*target.columns))


def upsert_latest(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key over target and batch."""
    rows = batch if target is None else target.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def fence(writes: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Keep a write only if its worker and attempt still own the job."""
    owners = jobs.filter(F.col("worker_id").isNotNull()).select(F.col("id").alias(job), "worker_id", "attempt")
    return writes.join(owners, [job, "worker_id", "attempt"], "left_semi")


def apply_transitions(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Fold status events (``job_id, seq, status, worker_id, ts``) into the job rows.

    A claim (``running``) keeps the first start time and adds one attempt; a terminal status sets
    the end; leaving ``running`` clears the worker. All folds are mergeable aggregates.
    """
    terminal = F.col("status").isin("succeeded", "failed", "cancelled")
    claimed = F.col("status") == "running"
    folded = events.groupBy(F.col("job_id").alias("id")).agg(
        F.max_by(F.struct("status", "worker_id"), "seq").alias("__last"),
        F.min_by(F.when(claimed, F.col("ts")), F.when(claimed, F.col("seq"))).alias("__start"),
        F.max_by(F.when(terminal, F.col("ts")), F.when(terminal, F.col("seq"))).alias("__end"),
        F.count(F.when(claimed, 1)).alias("__claims"),
    )
    out = jobs.join(folded, "id", "left")
    last = F.col("__last")
    changed = last.isNotNull()
    done = last["status"].isin("succeeded", "failed", "cancelled")
    return out.withColumns(
        {
            "status": F.when(changed, last["status"]).otherwise(F.col("status")),
            "worker_id": F.when(changed, F.when(last["status"] == "running", last["worker_id"])).otherwise(F.col("worker_id")),
            "started_at": F.coalesce("started_at", "__start"),
            "ended_at": F.when(changed, F.when(done, F.col("__end"))).otherwise(F.col("ended_at")),
            "attempt": F.col("attempt") + F.coalesce("__claims", F.lit(0)),
        }
    ).drop("__last", "__start", "__end", "__claims")


def allocate(
    requests: DataFrame, scope: Sequence[str], order: str = "id", seed: str = "seed_max", chunk: Column | None = None
) -> DataFrame:
    """``(scope.., order, run_number)``: one more than the previous number, but always above the request's seed.

    Scope columns are the parent's key, so never NULL. Closed form over the request order: position + running max of (seed + 1 - position). The
    maximum inside a chunk needs only positions inside the chunk; what earlier chunks add is one
    carried count and one carried maximum. Only the narrow columns travel, once: numbered inside their chunks they
    are written, and the chunks are counted once for both carries.
    """
    scope = list(scope)
    cut = int_chunk(order) if chunk is None else chunk
    narrow = requests.select(*scope, order, F.coalesce(seed, F.lit(0)).alias("__seed")).withColumn("__c", cut)
    narrow = narrow.repartition(*scope, "__c")  # never by the scope alone
    inside = W.partitionBy(*scope, "__c").orderBy(order)
    local = narrow.withColumn("__p", F.row_number().over(inside))
    local = local.withColumn("__lift", F.max(F.col("__seed") + 1 - F.col("__p")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    local = durable(local.drop("__seed"), "numbered")
    chunks = durable(local.groupBy(*scope, "__c").agg(F.count(F.lit(1)).alias("__n"), F.max("__lift").alias("__top")), "totals")
    most = ordered.widest(chunks, scope)
    # Ids with holes can leave one row to a chunk, so the carries are bounded as in ``running(sparse=True)``.
    counted = prior_totals(chunks, scope, "__c", {"__before": ("sum", "__n")}, most).fillna(0, ["__before"])
    lifted = counted.withColumn("__over", F.col("__top") - F.col("__before"))
    carried = prior_totals(lifted, scope, "__c", {"__carry": ("max", "__over")}, most)
    out = local.join(carried.select(*scope, "__c", "__before", "__carry"), [*scope, "__c"])
    shift = F.greatest("__carry", F.col("__lift") - F.col("__before"))
    return out.select(*scope, order, (F.col("__before") + F.col("__p") + shift).cast("bigint").alias("run_number"))


def bump(counters: DataFrame, imports: DataFrame, keys: Sequence[str], number: str = "emitted_run_number") -> DataFrame:
    """Counters after imports: next number is at least one above every imported number."""
    seen = imports.groupBy(*keys).agg((F.max(number) + 1).alias("__seen"))
    out = counters.join(seen, list(keys), "full_outer")
    return out.select(*keys, F.greatest("next_number", "__seen").alias("next_number"))


def merge_values(patches: DataFrame, job: str = "job_id", seq: str = "seq", key: str = "key", value: str = "value") -> DataFrame:
    """Latest value per (job, key): shallow merge where the right-most patch wins."""
    return patches.groupBy(job, key).agg(F.max_by(value, seq).alias(value))


def explode_patches(patches: DataFrame, patch: str, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """JSON object patches to one row per top-level key (values keep their JSON text)."""
    spark = patches.sparkSession
    parsed = patches.select(job, seq, F.parse_json(patch).alias("__v"))
    each = spark.tvf.variant_explode(F.col("__v").outer()).toDF("__pos", "key", "__x")
    return parsed.lateralJoin(each).select(job, seq, "key", F.to_json("__x").alias("value"))


def merge_summaries(patches: DataFrame, job: str = "job_id") -> DataFrame:
    """One map per job after merging; a map holds distinct top-level keys only."""
    merged = merge_values(patches, job)
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return merged.groupBy(job).agg(F.map_from_entries(entries).alias("summary"))


def run_label(stem: str | Column) -> Column:
    """40-character slug: cleaned stem cut to 33, and 6 hex digits of the original stem's SHA-1."""
    raw = F.col(stem) if isinstance(stem, str) else stem
    slug = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9_-]+", "-"), r"^[-_]+|[-_]+\z", "")
    return F.concat(F.substring(slug, 1, 33), F.lit("_"), F.substring(F.sha1(raw.cast("binary")), 1, 6))


def label_stem(repo: Column, kind: Column, program: Column, version: Column, config_base: Column, job: Column) -> Column:
    return F.concat_ws("_", repo, kind, program, version, config_base, F.substring(job.cast("string"), 1, 8))


def infer_keys(df: DataFrame, path: str, roots: Sequence[str], base: str = "base") -> DataFrame:
    """Program, version, dataset, split and results number read from a path; NULL where absent."""
    import re

    spelled = {r.strip("/") for r in roots} | {f"{base}/{r}".strip("/") for r in roots}
    alternatives = "|".join(re.escape(r) for r in sorted(spelled, key=len, reverse=True))
    get = lambda rx, i: F.nullif(F.regexp_extract(F.col(path), rx, i), F.lit(""))
    program = rf"(?:{alternatives})/([^/]+)/([^/]+)/"
    split = r"data/splits/(\d+)_(\d+)\.ya?ml\z"
    number = rf"(?:{alternatives})/[^/]+/[^/]+/results/(\d{{4}})(?:/|\z)"
    return df.withColumns(
        {
            "program": get(program, 1),
            "version": get(program, 2),
            "dataset": get(split, 1),
            "split": get(split, 2),
            "results_number": get(number, 1).cast("bigint"),
        }
    )
