"""Log parsing: status lines, optimizer progress, phase, errors, tail."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyframe.functions.exprs import pct, to_count
from tallyframe.plans.ordered import first_n

# The line formats runs print.
STATUS = (
    r"\[(\d+)/(\d+)\]\s*Acc:\s*([\d.]+)%\s*\|\s*Tokens:\s*([\d,]+)\s*\(in:([\d,]+)/out:([\d,]+)\)\s*\|\s*"
    r"Cost:\s*\$([\d.]+)\s*\|\s*Latency:\s*avg=(\d+)ms,\s*med=(\d+)ms(?:,\s*var=(\d+)ms²)?\s*\|\s*ETA:\s*(\S+)"
)
PROGRESS_BAR = r"(\d+)/(\d+)\s*\[(\d+:\d+(?::\d+)?|\?)<(\d+:\d+(?::\d+)?|\?),\s*([\d.?]+)([a-zA-Z/]+)\]"
ITERATION_SELECTED = r"Iteration (\d+):\s*Selected"
ITERATION_NEW = r"Iteration (\d+):\s*New program candidate index"
BEST_SCORE = r"Best valset aggregate score so far:\s*([\d.]+)"
FRONT_SCORE = r"Valset pareto front aggregate score:?\s*([\d.]+)"
BUDGET = r"Running GEPA for approx (\d+) metric calls"
COMPILE_DONE = r"Compilation complete|=== eval start"
EVAL_DONE = r"=== done|Eval complete|Saved results"
EVAL_START = "=== eval start"
ERRORS = r"ERROR [^\n]+|Traceback[^\n]+|AdapterParseError[^\n]+"

_STATUS_FIELDS = (
    "rows_done", "rows_total", "acc_pct", "tokens_total", "tokens_in", "tokens_out", "cost_usd", "avg_ms", "med_ms", "var_ms2", "eta",
)


def status_struct(text: Column) -> Column:
    """The eleven fields of a status text; the pattern runs once and the fields are cut from its rewriting."""
    fields = F.split(F.regexp_replace(text, F.lit(STATUS), F.lit("\x01".join(f"${i + 1}" for i in range(len(_STATUS_FIELDS))))), "\x01")

    def read(i: int, name: str) -> Column:
        raw = F.get(fields, F.lit(i))
        if name == "eta":
            return raw.alias(name)
        if name in ("acc_pct", "cost_usd"):
            return raw.try_cast("double").alias(name)
        return to_count(raw).alias(name)

    return F.struct(*[read(i, n) for i, n in enumerate(_STATUS_FIELDS)])


def _status_texts(text: Column) -> Column:
    """All status texts of a line; lines without the label are not searched."""
    return F.when(F.contains(text, F.lit("Acc:")), F.regexp_extract_all(text, F.lit(STATUS), 0))


def parse_status(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines that hold a status text, with its eleven fields; several per line give several rows."""
    found = lines.select("*", F.explode(_status_texts(F.col(text))).alias("__s"))
    return found.withColumn("__f", status_struct(F.col("__s"))).select(*lines.columns, "__f.*")


def with_percent(df: DataFrame) -> DataFrame:
    rows = F.col("rows_done")
    return df.withColumns(
        {
            "rows_pct": pct("rows_done", "rows_total", "rows"),
            "cost_per_1k_rows": F.when(rows > 0, F.round(F.col("cost_usd") * 1000 / rows, 4)),
        }
    )


def latest_status(lines: DataFrame, job: str = "job_id", seq: str = "seq", text: str = "line") -> DataFrame:
    """Last status text per job in line order; parsing happens once per job, after the aggregate."""
    last = F.try_element_at(_status_texts(F.col(text)), F.lit(-1))
    hits = lines.select(job, seq, last.alias("__s")).filter(F.col("__s").isNotNull())
    best = hits.groupBy(job).agg(F.max_by("__s", seq).alias("__s"))
    return with_percent(best.withColumn("__f", status_struct(F.col("__s"))).select(job, "__f.*"))


def progress_facts(lines: DataFrame, text: str = "line") -> DataFrame:
    """Per-line facts the per-job progress is folded from (also used on streams)."""
    t = F.col(text)
    bars = F.regexp_extract_all(t, F.lit(PROGRESS_BAR), 0)
    rollout = F.filter(bars, lambda b: F.contains(F.regexp_extract(b, PROGRESS_BAR, 6), F.lit("rollout")))
    last = lambda rx: F.try_element_at(F.regexp_extract_all(t, F.lit(rx), 1), F.lit(-1))
    return lines.withColumns(
        {
            "__status": F.try_element_at(_status_texts(t), F.lit(-1)),
            "__bar": F.coalesce(F.try_element_at(rollout, F.lit(-1)), F.try_element_at(bars, F.lit(-1))),
            "__preferred": F.when(F.size(rollout) > 0, 1).otherwise(0),
            "__budget": F.try_element_at(F.regexp_extract_all(t, F.lit(BUDGET), 1), F.lit(1)).cast("bigint"),
            "__iteration": F.array_max(F.transform(F.regexp_extract_all(t, F.lit(ITERATION_SELECTED), 1), lambda x: x.cast("bigint"))),
            "__best": last(BEST_SCORE).try_cast("double"),
            "__front": last(FRONT_SCORE).try_cast("double"),
            "__new": F.regexp_count(t, F.lit(ITERATION_NEW)),
            "__eval_start": F.contains(t, F.lit(EVAL_START)),
            "__compile_done": t.rlike(COMPILE_DONE),
            "__eval_done": t.rlike(EVAL_DONE),
            "__text": t.rlike(r"\S"),
            "__error": F.regexp_extract_all(t, F.lit(ERRORS), 0),
        }
    )


def progress_folds(seq: str = "seq") -> list[Column]:
    """Mergeable aggregates over ``progress_facts``: every one combines map-side."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name)

    return [
        last("__status"),
        F.max_by("__bar", F.when(F.col("__bar").isNotNull(), F.struct("__preferred", seq))).alias("__bar"),
        F.min_by("__budget", F.when(F.col("__budget").isNotNull(), F.col(seq))).alias("budget"),
        F.max("__iteration").alias("last_iteration"),
        last("__best").alias("best_score"),
        last("__front").alias("front_score"),
        F.sum("__new").cast("bigint").alias("new_candidates"),
        F.bool_or("__eval_start").alias("__eval_start"),
        F.bool_or("__compile_done").alias("__compile_done"),
        F.bool_or("__eval_done").alias("__eval_done"),
        F.bool_or("__text").alias("__text"),
        F.sum(F.size("__error")).cast("bigint").alias("errors"),
        F.max_by(F.try_element_at("__error", F.lit(-1)), F.when(F.size("__error") > 0, F.col(seq))).alias("last_error"),
    ]


def phase_of() -> Column:
    has_eval = F.col("__status").isNotNull() | F.col("__eval_start")
    return (
        F.when(has_eval & ~F.col("__eval_done"), "eval")
        .when(F.col("__eval_done"), "done")
        .when(F.col("__compile_done") | has_eval, "compile-done")
        .when(~F.col("__text"), "unknown")
        .otherwise("compile")
    )


def bar_columns() -> dict[str, Column]:
    part = lambda i: F.nullif(F.regexp_extract("__bar", PROGRESS_BAR, i), F.lit(""))
    cur, total = part(1).cast("bigint"), part(2).cast("bigint")
    return {
        "rollouts_cur": cur,
        "rollouts_total": total,
        "rollouts_pct": pct(cur, total),
        "elapsed": part(3),
        "remaining": part(4),
        "rate": F.concat(part(5), part(6)),
    }


def optimizer_progress(lines: DataFrame, job: str = "job_id", seq: str = "seq", text: str = "line") -> DataFrame:
    """Optimizer progress per job; jobs that printed no bar, iteration or budget are left out."""
    folded = progress_facts(lines, text).groupBy(job).agg(*progress_folds(seq))
    out = folded.withColumns(bar_columns()).filter(
        F.col("__bar").isNotNull() | F.col("last_iteration").isNotNull() | F.col("budget").isNotNull()
    )
    return out.select(
        job, "rollouts_cur", "rollouts_total", "rollouts_pct", "elapsed", "remaining", "rate", "budget",
        "last_iteration", "best_score", "front_score", "new_candidates",
    )


def phase(
    lines: DataFrame, job: str = "job_id", text: str = "line", compile_done: str = COMPILE_DONE, eval_done: str = EVAL_DONE
) -> DataFrame:
    """Phase per job from three flags; the patterns can be replaced for other printouts."""
    t = F.col(text)
    flags = lines.groupBy(job).agg(
        F.bool_or(t.rlike(STATUS) | F.contains(t, F.lit(EVAL_START))).alias("__has_eval"),
        F.bool_or(t.rlike(compile_done)).alias("__compile_done"),
        F.bool_or(t.rlike(eval_done)).alias("__eval_done"),
        F.bool_or(t.rlike(r"\S")).alias("__text"),
    )
    label = (
        F.when(F.col("__has_eval") & ~F.col("__eval_done"), "eval")
        .when(F.col("__eval_done"), "done")
        .when(F.col("__compile_done") | F.col("__has_eval"), "compile-done")
        .when(~F.col("__text"), "unknown")
        .otherwise("compile")
    )
    return flags.select(job, label.alias("phase"))


def parse_with(lines: DataFrame, fn: Callable[[str], Iterable[dict]], schema: str, keep: Sequence[str] = ("job_id", "seq"), text: str = "line") -> DataFrame:
    """User parser: ``fn(line)`` yields any number of records with the fields of ``schema``; runs on Arrow batches."""
    names = T._parse_datatype_string(schema).fieldNames()
    carried = list(keep)

    def batches(frames):
        for pdf in frames:
            found = [(*key, *(rec.get(n) for n in names)) for *key, line in pdf[[*carried, text]].itertuples(index=False) for rec in fn(line)]
            yield pd.DataFrame(found, columns=[*carried, *names])

    out = T.StructType([*[lines.schema[c] for c in carried], *T._parse_datatype_string(schema).fields])
    return lines.select(*carried, text).mapInPandas(batches, out)


def register_parser(spark: SparkSession, name: str, fn: Callable[[str], Iterable[dict]]) -> None:
    """``fn`` as a table function for SQL: ``from lines, lateral name(line, 'field type, ..')``.

    The result's columns follow from the second argument, a constant list of fields with simple types. Lines go to the
    function in Arrow batches.
    """

    class Parse:
        @staticmethod
        def analyze(line: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
            if not fields.isConstantExpression or not fields.value:
                raise ValueError("the fields are a constant text: 'name type, ..'")
            out = T.StructType()
            for field in fields.value.split(","):
                column, kind = field.split()
                out = out.add(column, T._parse_datatype_json_value({"bigint": "long", "int": "integer"}.get(kind.lower(), kind.lower())))
            return AnalyzeResult(out)

        def eval(self, line: str, fields: str):
            names = [field.split()[0] for field in fields.split(",")]
            for rec in fn(line) if line is not None else ():
                yield tuple(rec.get(n) for n in names)

    spark.udtf.register(name, F.udtf(Parse, useArrow=True))


def log_errors(lines: DataFrame, job: str = "job_id", seq: str = "seq", text: str = "line") -> DataFrame:
    """Error matches per job: how many, and the last one cut to 240 characters."""
    hits = F.regexp_extract_all(F.col(text), F.lit(ERRORS), 0)
    found = lines.select(job, seq, hits.alias("__h")).filter(F.size("__h") > 0)
    return found.groupBy(job).agg(
        F.sum(F.size("__h")).alias("errors"), F.substring(F.max_by(F.try_element_at("__h", F.lit(-1)), seq), 1, 240).alias("last_error")
    )


def tail(lines: DataFrame, n: int = 5000, keys: Sequence[str] = ("job_id",), seq: str = "seq") -> DataFrame:
    """Last ``n`` lines per job; partitions are pruned to ``n`` before the shuffle."""
    return first_n(lines, keys, [F.col(seq).desc()], n)
