"""A: sources, sinks and example shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.checks.registry import check
from tallyframe.operators import examples as ex
from tallyframe.plans.durable import scratch
from tallyframe.sources import configs, jsonl, results
from tallyframe.streaming import sinks

_RESULT_COLS = "run_id, example_idx, score, latency, cost, tokens_in, tokens_out, error"


#: Lines of one text file at most, about: a task that writes or reads a file does not grow with the table.
FILE_LINES = 20_000


def _write_lines(df, order: str, path: str, partitions: int = 4, file_lines: int = FILE_LINES) -> str:
    """Text files whose name order follows ``order`` (one file per range), ``partitions`` at least."""
    partitions = max(partitions, -(-df.count() // file_lines))
    df.repartitionByRange(partitions, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


@check(
    "a1_read_examples",
    """select row_number() over (order by doc_id) - 1 as row_idx, doc_id, md5(text) as text_md5 from documents""",
)
def a1(fx):
    lines = fx.documents.select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    blanks = fx.documents.filter("doc_id % 7 = 0").select("doc_id", F.lit("   ").alias("value"))
    path = _write_lines(lines.union(blanks), "doc_id", scratch(fx.spark, "examples"))
    return jsonl.read_examples(fx.spark, path).select(
        "row_idx",
        F.variant_get("record", "$.doc_id", "bigint").alias("doc_id"),
        F.md5(F.variant_get("record", "$.text", "string").cast("binary")).alias("text_md5"),
    )


@check(
    "a2_select_split",
    """select s.pos, s.row_idx, e.dataset, e.n_chars from splits s join examples e on e.row_idx = s.row_idx where s.split = 'test'""",
)
def a2(fx):
    return ex.select_split(fx.examples, fx.splits, "test").select("pos", "row_idx", "dataset", "n_chars")


@check("a2_select_all", "select row_idx as pos, row_idx, n_chars from examples")
def a2_all(fx):
    return ex.select_split(fx.examples, fx.splits, "all").select("pos", "row_idx", "n_chars")


@check(
    "a2_split_misses",
    """select s.pos, s.row_idx, e.row_idx is not null as found from bad_splits s
       left join examples e on e.row_idx = s.row_idx where s.split = 'val'""",
)
def a2_misses(fx):
    return ex.select_split(fx.examples, fx.bad_splits, "val", strict=False).select("pos", "row_idx", "found")


@check(
    "a3_audit_splits",
    """
with c as (select split, row_idx, count(*) as n from bad_splits group by split, row_idx)
select 'unknown_split' as reason, split, cast(row_idx as varchar) as row_idx, n from c where split not in ('train','val','test')
union all select 'negative_index', split, cast(row_idx as varchar), n from c where row_idx < 0
union all select 'repeated_index', split, cast(row_idx as varchar), n from c where n > 1
union all select 'out_of_range', split, cast(row_idx as varchar), n from c
  where row_idx >= 0 and row_idx not in (select row_idx from examples)
union all select 'overlap', string_agg(split, '+' order by split), cast(row_idx as varchar), count(*) from c
  where split in ('train','val','test') group by row_idx having count(*) > 1""",
)
def a3(fx):
    return ex.audit_splits(fx.bad_splits, fx.examples)


@check(
    "a4_shape_examples",
    """
select doc_id as row_idx, doc_id % 6 as shape,
  case doc_id % 6 when 0 then md5(text) when 1 then md5(text) when 2 then md5(text) when 5 then md5('top') end as question_md5,
  doc_id % 6 = 3 as json_null, doc_id % 6 = 4 as is_missing,
  case when doc_id % 2 = 0 then '{"label":' || cast(n_chars as varchar) || '}' else '{}' end as output
from documents""",
)
def a4(fx):
    d = fx.documents
    shape = F.col("doc_id") % 6
    body = (
        F.when(shape == 0, F.to_json(F.struct(F.struct(F.col("text").alias("question")).alias("input"))))
        .when(shape == 1, F.to_json(F.struct(F.col("text").alias("input"))))
        .when(shape == 2, F.to_json(F.struct(F.col("text").alias("question"))))
        .when(shape == 3, F.lit('{"input":{"question":null}}'))
        .when(shape == 4, F.lit('{"input":{"other":1}}'))
        .otherwise(F.lit('{"input":{"other":1},"question":"top"}'))
    )
    tail = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit(',"output":{"label":'), F.col("n_chars").cast("string"), F.lit("}}"))
    ).otherwise(F.lit("}"))
    raw = F.concat(F.expr("left(body, length(body) - 1)"), tail)
    src = d.withColumn("body", body).select(F.col("doc_id").alias("row_idx"), F.parse_json(raw).alias("record"))
    out = ex.shape_examples(src, ["question"], strict=False)
    return out.select(
        "row_idx",
        (F.col("row_idx") % 6).alias("shape"),
        F.md5(F.try_variant_get("question", "$", "string").cast("binary")).alias("question_md5"),
        F.coalesce(F.is_variant_null("question"), F.lit(False)).alias("json_null"),
        (F.size("missing") > 0).alias("is_missing"),
        F.to_json("output").alias("output"),
    )


@check("a5_write_results", f"select {_RESULT_COLS}, seq from eval_results")
def a5(fx):
    path = scratch(fx.spark, "results")
    rows = fx.eval_results.withColumns({"feedback": F.lit(None).cast("string"), "prediction": F.lit(None).cast("string")})
    results.write_results(rows, path)
    back = fx.spark.read.schema(results.RESULT_SCHEMA + ", run_id string").json(path)
    return results.from_record(back).select(*_RESULT_COLS.split(", "), "seq")


@check(
    "a6_read_results",
    """select run_id, example_idx, case when example_idx % 11 = 3 then 1e0 else score end as score, tokens_in, error
       from eval_results where example_idx % 11 not in (1, 2, 4, 5)""",
)
def a6(fx):
    rows = fx.eval_results
    good = F.to_json(
        F.struct(
            "run_id", "example_idx", "score", "latency", "cost",
            F.struct(F.col("tokens_in").alias("input"), F.col("tokens_out").alias("output")).alias("tokens"), "error",
        )
    )
    kind = F.col("example_idx") % 11
    value = (
        F.when(kind == 1, F.lit("{broken"))
        .when(kind == 2, F.lit("  "))
        .when(kind == 3, F.regexp_replace(good, r'"score":[^,]*', '"score":true'))
        .when(kind == 4, F.regexp_replace(good, r'"score":[^,]*', '"score":"0.5"'))
        .when(kind == 5, F.lit("[1]"))
        .otherwise(good)
    )
    path = _write_lines(rows.select("example_idx", value.alias("value")), "example_idx", scratch(fx.spark, "lines"))
    return jsonl.read_results(fx.spark, path).select("run_id", "example_idx", "score", "tokens_in", "error")


_RUNS_SQL = """
select 'prog' as program, 'v_' || coalesce(run_id, 'none') as version, cast(1 + ascii(coalesce(run_id, 'none')) % 9 as bigint) as run_number,
  1 + example_idx % 2 as eval_number, example_idx, score, latency, cost, tokens_in, tokens_out, error
from eval_results"""
_RUN_COLS = "program version run_number eval_number example_idx score latency cost tokens_in tokens_out error".split()


def _write_runs(fx, root: str, evals: tuple[int, ...]) -> None:
    rows = results.to_record(fx.eval_results)
    for r in rows.select("run_id").distinct().collect():  # one folder per run, as separate jobs would write them
        name = r.run_id or "none"
        run = f"{root}/prog/v_{name}/results/{1 + ord(name[0]) % 9:04d}/evals"
        mine = rows.filter(F.col("run_id").eqNullSafe(r.run_id)).drop("run_id")
        for k in evals:
            mine.filter(F.col("example_idx") % 2 == k).write.json(f"{run}/{k + 1:04d}/results.jsonl")
        if 0 in evals:
            mine.write.json(f"{run}/draft/results.jsonl")  # not a four-digit name: never read


@check("a8_read_runs", _RUNS_SQL)
def a8(fx):
    root = scratch(fx.spark, "runs")
    _write_runs(fx, root, (0, 1))
    return results.read_runs(fx.spark, root).select(*_RUN_COLS)


@check("a8_follow_runs_stream", _RUNS_SQL)
def a8_stream(fx):
    """Taken in twice, the second evaluation of every run written in between."""
    root, out, state = (scratch(fx.spark, x) for x in ("runs", "taken", "state"))
    for k in (0, 1):
        _write_runs(fx, root, (k,))
        rows = results.follow_runs(fx.spark, root)
        sinks.append_sink(rows, out, state).awaitTermination()
    return fx.spark.read.schema(rows.schema).parquet(out).select(*_RUN_COLS)


@check(
    "a9_flatten_struct",
    """select doc_id, cast(doc_id as varchar) as "RUN_ID", coalesce(lang, '') as "RUN_DATA_LANG",
       case when doc_id % 3 = 0 then '' else source end as "RUN_DATA_SOURCE", cast(n_chars as varchar) as "SIZE" from documents""",
)
def a9(fx):
    nested = fx.documents.select(
        "doc_id",
        F.struct(
            F.struct(
                F.col("doc_id").alias("id"),
                F.struct("lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")).alias("data"),
            ).alias("run"),
            F.col("n_chars").alias("size"),
        ).alias("cfg"),
    )
    return configs.flatten_struct(nested, "cfg", ("doc_id",))


@check(
    "a9_flatten_json",
    """
select doc_id, 'RUN_ID' as name, cast(doc_id as varchar) as value from documents
union all select doc_id, 'RUN_DATA_LANG', lang from documents
union all select doc_id, 'RUN_DATA_SOURCE', case when doc_id % 3 = 0 then '' else source end from documents
union all select doc_id, 'TAGS', '[1,' || cast(n_chars as varchar) || ']' from documents""",
)
def a9_json(fx):
    cfg = F.concat(
        F.lit('{"run":{"id":'), F.col("doc_id").cast("string"), F.lit(',"data":{"lang":"'), F.col("lang"),
        F.lit('","source":'), F.when(F.col("doc_id") % 3 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("source"), F.lit('"'))),
        F.lit('}},"none":{},"tags":[1,'), F.col("n_chars").cast("string"), F.lit("]}"),
    )
    return configs.flatten_json(fx.documents.select("doc_id", F.parse_json(cfg).alias("cfg")), "cfg", ("doc_id",))


@check(
    "a10_media_refs",
    """
select page_id, 'cover' as path, url || '.png' as media from pages where page_id % 3 = 0
union all select page_id, 'gallery.1.src', url || '.JPG' from pages
union all select page_id, 'gallery.2', 'x' || cast(page_id as varchar) || '.webp' from pages""",
)
def a10(fx):
    u = F.col("url")
    rec = F.struct(
        F.concat(u, F.when(F.col("page_id") % 3 == 0, ".png").otherwise(".Png")).alias("cover"),
        F.array(
            F.to_json(F.struct(F.lit(1).alias("n"))),
            F.to_json(F.struct(F.concat(u, F.lit(".JPG")).alias("src"))),
        ).alias("raw"),
    )
    text = F.concat(
        F.lit('{"cover":'), F.to_json(F.array(rec["cover"])), F.lit(',"gallery":['), F.array_join(rec["raw"], ","),
        F.lit(',"x'), F.col("page_id").cast("string"), F.lit('.webp"],"a.png":"text"}'),
    )
    text = F.regexp_replace(F.regexp_replace(text, r'"cover":\[', '"cover":'), r'\],"gallery"', ',"gallery"')
    return ex.extract_media_refs(fx.pages.select("page_id", F.parse_json(text).alias("rec")), "rec", "page_id")


@check(
    "a9_flatten_json_deep",
    """select doc_id, upper(repeat('a_', cast(doc_id % 41 as int)) || 'z') as name, cast(n_chars as varchar) as value from documents""",
)
def a9_deep(fx):
    """Objects up to 40 levels deep."""
    d = (F.col("doc_id") % 41).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":'), d), F.lit('{"z":'), F.col("n_chars").cast("string"), F.lit("}"), F.repeat(F.lit("}"), d))
    return configs.flatten_json(fx.documents.select("doc_id", F.parse_json(text).alias("cfg")), "cfg", ("doc_id",))


@check(
    "a10_media_refs_deep",
    """select page_id, repeat('n.0.', cast(page_id % 21 as int)) || 'm' as path, url || '.png' as media from pages""",
)
def a10_deep(fx):
    """Objects and lists in turn, up to 40 levels deep."""
    d = (F.col("page_id") % 21).cast("int")
    text = F.concat(F.repeat(F.lit('{"n":['), d), F.lit('{"m":"'), F.col("url"), F.lit('.png"}'), F.repeat(F.lit("]}"), d))
    return ex.extract_media_refs(fx.pages.select("page_id", F.parse_json(text).alias("rec")), "rec", "page_id")


@check(
    "a11_media_budget",
    """
with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10e0 as size_mb,
    cast(l_partkey * 10 as bigint) as width, cast(l_suppkey * 100 as bigint) as height from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, size_mb, width, height, size_mb * 1.33e0 > 3.5e0 as over_size, width * height > 33000000 as over_pixels,
  cast(floor(width * s) as bigint) as new_width, cast(floor(height * s) as bigint) as new_height
from (select *, case when width * height > 33000000 then sqrt(33000000e0 / (width * height)) else 1e0 end as s from m)""",
)
def a11(fx):
    m = fx.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") / 10).alias("size_mb"),
        (F.col("l_partkey") * 10).alias("width"),
        (F.col("l_suppkey") * 100).alias("height"),
    )
    return ex.media_budget(m)
