"""K and M5: log parsing."""

from __future__ import annotations

import re

from tallyframe.checks.registry import check
from tallyframe.operators import logs as lg

# The marked patterns of the operators; the fields are read one by one here.
_S, _B = lg.STATUS, lg.PROGRESS_BAR


def _g(rx: str, i: int, kind: str) -> str:
    raw = f"nullif(regexp_extract(line, '{rx}', {i}), '')"
    return f"try_cast(replace({raw}, ',', '') as {kind})" if kind != "varchar" else raw


_STATUS = f"""s as (select job_id, seq, {_g(_S, 1, 'bigint')} as rows_done, {_g(_S, 2, 'bigint')} as rows_total, {_g(_S, 3, 'double')} as acc_pct,
  {_g(_S, 4, 'bigint')} as tokens_total, {_g(_S, 5, 'bigint')} as tokens_in, {_g(_S, 6, 'bigint')} as tokens_out, {_g(_S, 7, 'double')} as cost_usd,
  {_g(_S, 8, 'bigint')} as avg_ms, {_g(_S, 9, 'bigint')} as med_ms, {_g('var=(\\d+)ms²', 1, 'bigint')} as var_ms2, {_g('ETA:\\s*(\\S+)', 1, 'varchar')} as eta
  from log_lines where regexp_matches(line, '{_S}'))"""
_LATEST = "l as (select * from (select *, row_number() over (partition by job_id order by seq desc) as r from s) t where r = 1)"


@check("k1_parse_status", f"with {_STATUS} select * from s")
def k1(fx):
    return lg.parse_status(fx.log_lines).drop("line", "ts")


@check(
    "k2_latest_status",
    f"""with {_STATUS}, {_LATEST} select job_id, rows_done, rows_total, acc_pct, tokens_total, tokens_in, tokens_out, cost_usd, avg_ms, med_ms, var_ms2, eta,
        round(100e0 * rows_done / rows_total, 1) as rows_pct, round(cost_usd * 1000 / rows_done, 4) as cost_per_1k_rows from l""",
)
def k2(fx):
    return lg.latest_status(fx.log_lines)


PROGRESS_SQL = f"""
b as (select job_id, arg_max(line, case when contains(line, 'rollout') then 100000000 else 0 end + seq) as line from log_lines where regexp_matches(line, '{_B}') group by job_id),
o as (select job_id, try_cast(arg_min(regexp_extract(line, 'approx (\\d+) metric', 1), seq) filter (contains(line, 'approx')) as bigint) as budget,
    max(try_cast(nullif(regexp_extract(line, 'Iteration (\\d+):\\s*Selected', 1), '') as bigint)) as last_iteration,
    try_cast(arg_max(regexp_extract(line, 'so far:\\s*([\\d.]+)', 1), seq) filter (contains(line, 'so far:')) as double) as best_score,
    try_cast(arg_max(regexp_extract(line, 'front aggregate score:?\\s*([\\d.]+)', 1), seq) filter (contains(line, 'front aggregate')) as double) as front_score,
    count(case when contains(line, 'New program candidate index') then 1 end) as new_candidates from log_lines group by job_id),
p as (select o.*, {_g(_B, 1, 'bigint')} as rollouts_cur, {_g(_B, 2, 'bigint')} as rollouts_total, {_g(_B, 3, 'varchar')} as elapsed,
    {_g(_B, 4, 'varchar')} as remaining, {_g(_B, 5, 'varchar')} || {_g(_B, 6, 'varchar')} as rate from o left join b on b.job_id = o.job_id),
pp as (select *, case when rollouts_cur <> 0 and rollouts_total <> 0 then round(100e0 * rollouts_cur / rollouts_total, 1) end as rollouts_pct from p)"""


@check(
    "k3_optimizer_progress",
    f"""with {PROGRESS_SQL.strip()} select job_id, rollouts_cur, rollouts_total, rollouts_pct, elapsed, remaining, rate, budget, last_iteration, best_score, front_score,
        new_candidates from pp where rollouts_cur is not null or last_iteration is not null or budget is not null""",
)
def k3(fx):
    return lg.optimizer_progress(fx.log_lines)


PHASE_SQL = f"""ph as (select job_id, case when e and not d then 'eval' when d then 'done' else 'compile' end as phase from (select job_id,
  bool_or(regexp_matches(line, '{_S}') or contains(line, '=== eval start')) as e, bool_or(regexp_matches(line, '=== done|Eval complete|Saved results')) as d from log_lines group by job_id) t)"""


@check("k4_phase", f"with {PHASE_SQL} select job_id, phase from ph")
def k4(fx):
    return lg.phase(fx.log_lines)


@check(
    "k4_phase_override",
    """select job_id, case when e and not d then 'eval' when d then 'done' else 'compile' end as phase from (select job_id,
       bool_or(contains(line, 'Acc: ') or contains(line, '=== eval start')) as e, bool_or(contains(line, 'index: 1')) as d from log_lines group by job_id) t""",
)
def k4_override(fx):
    return lg.phase(fx.log_lines, eval_done=r"index: 1")


@check(
    "k5_log_errors",
    "select job_id, count(*) as errors, arg_max(line, seq) as last_error from log_lines where line like 'ERROR %' group by job_id",
)
def k5(fx):
    return lg.log_errors(fx.log_lines)


@check(
    "k6_tail",
    "select job_id, seq, line from (select *, row_number() over (partition by job_id order by seq desc) as r from log_lines) t where r <= 20",
)
def k6(fx):
    return lg.tail(fx.log_lines, 20).select("job_id", "seq", "line")


@check(
    "k6_tail_deep",
    "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id desc) as r from documents) t where r <= 5000",
)
def k6_deep(fx):
    return lg.tail(fx.documents.select("lang", "doc_id"), 5000, ["lang"], "doc_id")


@check(
    "m5_user_parser",
    r"""select job_id, seq, unnest(regexp_extract_all(line, '\d+')) as number, length(line) as width from log_lines""",
)
def m5(fx):
    def numbers(line):
        return [{"number": n, "width": len(line)} for n in re.findall(r"[0-9]+", line)]

    return lg.parse_with(fx.log_lines, numbers, "number string, width bigint")


@check(
    "m5_user_parser_sql",
    r"""select job_id, seq, unnest(regexp_extract_all(line, '\d+')) as number, length(line) as width from log_lines""",
)
def m5_sql(fx):
    """The same parser as a table function; its columns follow from its argument."""

    def numbers(line):
        return [{"number": n, "width": len(line)} for n in re.findall(r"[0-9]+", line)]

    lg.register_parser(fx.spark, "line_numbers", numbers)
    return fx.spark.sql("select job_id, seq, number, width from {lines}, lateral line_numbers(line, 'number string, width bigint')", lines=fx.log_lines)
