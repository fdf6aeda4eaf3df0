"""Batch scoring and run metrics."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterable, Sequence
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import ROWS_PER_CHUNK, Running, int_chunk, running
from tallyframe.plans.quantiles import exact_median
from tallyframe.plans.running_median import rank_error, running_median, running_median_sketch
from tallyframe.sources.variants import field, is_object

PREDICTION = "prediction string, latency double, tokens_in bigint, tokens_out bigint, error string"


# ---------------------------------------------------------------- user code


def apply_predictor(df: DataFrame, fn: Callable[..., object] | Column, inputs: Sequence[str]) -> DataFrame:
    """Run a predictor on every example.

    A Column stays inside Spark's generated code. A Python callable ``fn(**inputs)`` returns the
    prediction text, or a dict with ``prediction`` and optional ``tokens_in``/``tokens_out``; it
    runs on Arrow batches, and an exception becomes ``error`` while the row is kept.
    """
    if isinstance(fn, Column):
        return df.select(
            "*",
            fn.cast("string").alias("prediction"),
            F.lit(0.0).alias("latency"),
            F.lit(0).cast("bigint").alias("tokens_in"),
            F.lit(0).cast("bigint").alias("tokens_out"),
            F.lit(None).cast("string").alias("error"),
        )
    names = list(inputs)

    def one(row: dict) -> tuple:
        began = time.perf_counter()
        try:
            out = fn(**row)
            out = out if isinstance(out, dict) else {"prediction": out}
            text = None if out.get("prediction") is None else str(out["prediction"])
            return text, time.perf_counter() - began, int(out.get("tokens_in", 0)), int(out.get("tokens_out", 0)), None
        except Exception as e:  # user code: anything may come out
            return None, 0.0, 0, 0, str(e) or type(e).__name__

    fields = ["prediction", "latency", "tokens_in", "tokens_out", "error"]

    def batches(frames):
        for pdf in frames:
            rows = [one(r) for r in pdf[names].to_dict("records")]
            add = pd.DataFrame(rows, columns=fields, index=pdf.index).astype({"tokens_in": "int64", "tokens_out": "int64"})
            yield pd.concat([pdf, add], axis=1)

    schema = T.StructType(df.schema.fields + T._parse_datatype_string(PREDICTION).fields)
    return df.mapInPandas(batches, schema)


def _metric_call(fn: Callable[..., object]) -> Callable[..., object]:
    """Call a metric by the widest form its signature takes: five, three or two arguments.

    The trace is the third argument; the last two are filled by optimizers only and stay None here.
    """
    for extra in ((None, None, None), (None,), ()):
        try:
            inspect.signature(fn).bind({}, "", *extra)
        except TypeError:
            continue
        if not extra:
            return lambda example, prediction, trace=None: fn(example, prediction)
        return lambda example, prediction, trace=None, rest=extra[1:]: fn(example, prediction, trace, *rest)
    raise TypeError("a metric takes (example, prediction), (.., trace) or (.., trace, predictor, predictor trace)")


def python_metric(fn: Callable[..., object]) -> Callable[..., Column]:
    """Wrap ``metric(example, prediction[, trace[, name, name_trace]])`` as an Arrow UDF.

    Call the result with columns ``(example, prediction)`` or ``(example, prediction, trace)``. The metric returns
    a number, a boolean or ``{score, feedback}``; an exception becomes ``error``.
    """
    call = _metric_call(fn)
    kind = "score double, feedback string, error string"

    def judged(examples: list[dict], predictions: Iterable, traces: Iterable) -> pd.DataFrame:
        out = []
        for ex, pred, trace in zip(examples, predictions, traces):
            try:
                got = call(ex, pred, trace)
                if isinstance(got, dict):
                    note = got.get("feedback")
                    out.append((float(got["score"]), None if note is None else str(note), None))
                else:
                    out.append((float(got), None, None))
            except Exception as e:
                out.append((0.0, None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["score", "feedback", "error"])

    @F.pandas_udf(kind)
    def scored(example: pd.DataFrame, prediction: pd.Series) -> pd.DataFrame:
        return judged(example.to_dict("records"), prediction, repeat(None))

    @F.pandas_udf(kind)
    def traced(example: pd.DataFrame, prediction: pd.Series, trace: pd.Series) -> pd.DataFrame:
        return judged(example.to_dict("records"), prediction, trace)

    return lambda example, prediction, trace=None: scored(example, prediction) if trace is None else traced(example, prediction, trace)


def score(df: DataFrame, metric: Column, metric_error: Column | None = None) -> DataFrame:
    """Add ``score``; a failed prediction or metric zeroes the whole row and keeps it.

    ``metric`` is a number, or a struct ``(score, feedback, error)`` from ``python_metric``.
    """
    out = df.withColumn("__m", metric)
    nested = isinstance(out.schema["__m"].dataType, T.StructType)
    value = F.col("__m.score") if nested else F.col("__m").cast("double")
    note = F.col("__m.feedback") if nested else F.lit(None).cast("string")
    raised = F.col("__m.error") if nested else F.lit(None).cast("string")
    if metric_error is not None:
        raised = F.coalesce(raised, metric_error)
    prior = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("__e", F.coalesce(prior, raised)).withColumns({"score": value, "feedback": note})
    return zero_failed(out.drop("error").withColumnRenamed("__e", "error").drop("__m"))


def zero_failed(df: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    numbers = {c: 0.0 for c in ("score", "latency", "cost")} | {c: 0 for c in ("tokens_in", "tokens_out")}
    changes = {
        c: F.when(failed, F.lit(z)).otherwise(F.coalesce(F.col(c), F.lit(z))) for c, z in numbers.items() if c in df.columns
    }
    for text in ("feedback", "prediction"):
        if text in df.columns:
            changes[text] = F.when(~failed, F.col(text))
    return df.withColumns(changes)


def float_text(x: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, else ``1e-05`` form."""
    raw = x.cast("string")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0\z", "")
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+\z", "$1")
    sci = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(~F.contains(raw, F.lit("E")), raw).when((exponent >= -4) & (exponent < 16), plain).otherwise(sci)


def normalize_metric(df: DataFrame, col: str) -> DataFrame:
    """Variant metric output to ``score``, ``feedback`` and ``problem`` (NULL when usable)."""
    v = F.col(col)
    kind = F.schema_of_variant(v)
    number = F.regexp_like(kind, F.lit(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))

    def as_double(x: Column) -> Column:
        truth = F.try_variant_get(x, "$", "boolean").cast("int").cast("double")
        return F.when(F.schema_of_variant(x) == "BOOLEAN", truth).otherwise(F.try_variant_get(x, "$", "double"))

    value = F.when(number | (kind == "BOOLEAN"), as_double(v)).when(is_object(v), as_double(field(v, "score")))
    note = field(v, "feedback")
    given = F.when(is_object(v) & note.isNotNull() & ~F.is_variant_null(note), F.try_variant_get(note, "$", "string"))
    problem = (
        F.when(is_object(v) & field(v, "score").isNull(), "missing score")
        .when(is_object(v) & value.isNull(), "score is not a number")
        .when(value.isNull(), "unsupported metric output")
    )
    # Fixed value: the sentence given where a metric leaves no note.
    default = F.concat(F.lit("This trajectory got a score of "), float_text(value), F.lit("."))
    return df.withColumns(
        {"score": value, "feedback": F.when(problem.isNull(), F.coalesce(given, default)), "problem": problem}
    )


# ---------------------------------------------------------------- resume


def dedupe_results(results: DataFrame, keys: Sequence[str] = ("run_id", "example_idx"), order: str = "seq") -> DataFrame:
    """First row per (run, example): an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in results.columns if c not in keys]
    picked = results.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*results.columns)


def load_completed(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals of finished work per run; missing values count as 0, rows without an index are ignored."""
    rows = dedupe_results(results.filter(F.col("example_idx").isNotNull()), [*by, "example_idx"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"),
        F.sum(zero("score")).alias("score_sum"),
        F.sum(zero("latency")).alias("latency_sum"),
        F.sum(zero("tokens_in")).alias("tokens_in"),
        F.sum(zero("tokens_out")).alias("tokens_out"),
        F.sum(zero("cost")).alias("cost"),
    )


def remaining(examples: DataFrame, completed: DataFrame, keys: Sequence[str] = ("run_id", "example_idx")) -> DataFrame:
    done = completed.filter(F.col("example_idx").isNotNull()).select(*keys)
    return examples.join(done, list(keys), "left_anti")


# ---------------------------------------------------------------- summaries


def run_summary(results: DataFrame, by: Sequence[str] = ("run_id",), ok_only: bool = False) -> DataFrame:
    """Score %, tokens, cost, and latency mean, exact median and sample variance in ms.

    Two passes over the results, whatever the size of the largest run.
    """
    rows = results.filter(F.col("error").isNull()) if ok_only else results
    n = F.count(F.lit(1))
    stats = [
        n.alias("rows"),
        (F.sum(F.coalesce("score", F.lit(0.0))) / n * 100).alias("score_pct"),
        F.count("error").alias("errors"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
        (F.avg("latency") * 1000).alias("latency_avg_ms"),
        F.when(n >= 2, F.var_samp("latency") * 1e6).alias("latency_var_ms2"),
    ]
    out = exact_median(rows, by, F.col("latency"), "__med", stats)
    return out.withColumn("latency_med_ms", F.col("__med") * 1000).drop("__med")


def eval_summary(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Only rows with a numeric score count; half-even rounding at two places."""
    rows = F.count("score")
    pct = F.bround(F.avg("score") * 100, 2)
    return results.groupBy(*by).agg(rows.alias("rows"), F.coalesce(pct, F.lit(0.0)).alias("score_pct"))


def running_progress(
    results: DataFrame,
    run: str = "run_id",
    seq: str = "seq",
    elapsed: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    sketch: int | None = None,
) -> DataFrame:
    """State after each row of a run: counts, accuracy, tokens, cost, latency statistics, ETA.

    ``elapsed`` is seconds since the run started (default: summed latency so far). With ``sketch``, a size, the running
    median comes from mergeable sketches, for very long runs; ``latency_rank_error`` then says by what share of the
    rows so far its rank may be off. All else stays exact.
    """
    chunk = int_chunk(seq, rows_per_chunk)
    lat = F.coalesce("latency", F.lit(0.0))
    out = running(
        results,
        [run],
        [F.col(seq)],
        chunk,
        [
            Running("completed", "count"),
            Running("__score", "sum", F.coalesce("score", F.lit(0.0))),
            Running("run_tokens_in", "sum", F.coalesce("tokens_in", F.lit(0))),
            Running("run_tokens_out", "sum", F.coalesce("tokens_out", F.lit(0))),
            Running("run_cost", "sum", F.coalesce("cost", F.lit(0.0))),
            Running("__lat", "sum", lat),
            # milliseconds, so that squares keep their precision
            Running("__sq", "sum", (lat * 1000) * (lat * 1000)),
        ],
        sparse=True,
    )
    totals = durable(results.groupBy(F.col(run).alias("__run")).agg(F.count(F.lit(1)).alias("total")), "totals")
    out = out.join(totals, F.col(run).eqNullSafe(F.col("__run"))).drop("__run")
    n = F.col("completed")
    mean_ms = F.col("__lat") * 1000 / n
    spent = F.col("__lat") if elapsed is None else elapsed
    out = out.withColumns(
        {
            "accuracy_pct": F.col("__score") / n * 100,
            "latency_avg_ms": mean_ms,
            "latency_var_ms2": F.when(n >= 2, F.greatest(F.lit(0.0), (F.col("__sq") - n * mean_ms * mean_ms) / (n - 1))),
            "eta_s": spent / n * (F.col("total") - n),
        }
    ).drop("__score", "__lat", "__sq")
    values = results.select(F.col(run), F.col(seq), lat.alias("__x"))
    if sketch:
        out = out.withColumn("latency_rank_error", F.lit(rank_error(sketch)))
        med = running_median_sketch(values, run, seq, "__x", "__med", sketch, rows_per_chunk)
    else:
        med = running_median(values, run, seq, "__x", "__med", rows_per_chunk)
    med = med.select(F.col(run).alias("__run"), F.col(seq).alias("__seq"), (F.col("__med") * 1000).alias("latency_med_ms"))
    return out.join(med, F.col(run).eqNullSafe(F.col("__run")) & (F.col(seq) == F.col("__seq"))).drop("__run", "__seq")


def eta_text(seconds: Column) -> Column:
    short = F.format_string("%.0fs", F.bround(seconds, 0))
    return F.when(seconds < 60, short).otherwise(F.format_string("%.1fm", F.bround(seconds / 60, 1)))


def status_line(progress: DataFrame) -> DataFrame:
    """``running_progress`` rows as the one-line status text that ``operators.logs`` parses."""
    tin, tout = F.col("run_tokens_in"), F.col("run_tokens_out")
    ms = lambda c: F.format_string("%.0fms", F.bround(F.col(c), 0))
    var = F.when(
        F.col("latency_var_ms2").isNotNull(),
        F.concat(F.lit(", var="), F.format_string("%.0fms²", F.bround("latency_var_ms2", 0))),
    ).otherwise("")
    line = F.concat(
        F.format_string("[%d/%d] Acc: %.1f%%", "completed", "total", F.bround("accuracy_pct", 1)),
        F.lit(" | Tokens: "), F.format_number(tin + tout, 0),
        F.lit(" (in:"), F.format_number(tin, 0), F.lit("/out:"), F.format_number(tout, 0), F.lit(")"),
        F.format_string(" | Cost: $%.4f", F.bround("run_cost", 4)),
        F.lit(" | Latency: avg="), ms("latency_avg_ms"), F.lit(", med="), ms("latency_med_ms"), var,
        F.lit(" | ETA: "), eta_text(F.col("eta_s")),
    )
    return progress.withColumn("line", line)


# ---------------------------------------------------------------- re-aimed controls


def score_distinct(df: DataFrame, keys: Sequence[str], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate equal inputs once: fingerprint, score one representative each, join back.

    Copies collapse map-side before the scorer sees them. The scores are written before the join
    back, so the scorer runs once and a fingerprint shared by many rows can be split.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys]
    tagged = df.withColumn("fingerprint", F.sha2(F.to_json(F.array(*parts)), 256))
    once = tagged.groupBy("fingerprint").agg(*[F.any_value(k).alias(k) for k in keys])
    scored = durable(scorer(once).drop(*keys), "scored")
    return tagged.join(scored, "fingerprint")


def within_error_budget(
    results: DataFrame, max_errors: int, run: str = "run_id", seq: str = "seq", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Rows of a run up to and including the one whose error exceeds the budget."""
    bad = F.when(F.col("error").isNotNull(), 1).otherwise(0)
    out = running(
        results, [run], [F.col(seq)], int_chunk(seq, rows_per_chunk), [Running("errors_before", "sum", bad, before=True)], sparse=True
    )
    return out.filter(F.col("errors_before") <= max_errors)


def score_by_split(scores: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Mean score per candidate and split, and the train/val gap. One aggregate, no join."""
    means = [F.avg(F.when(F.col("split") == s, F.col("score"))).alias(f"{s}_score") for s in splits]
    out = scores.groupBy("candidate").agg(*means)
    return out.withColumn("gap", F.col("train_score") - F.col("val_score"))
