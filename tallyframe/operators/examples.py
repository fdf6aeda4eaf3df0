"""Examples and splits: selection, audit, shaping, media references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.plans.ordered import page_of
from tallyframe.sources.variants import field, is_object, is_string, leaves

SPLIT_NAMES = ("train", "val", "test")
# The recognised endings, in exactly these spellings.
MEDIA_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".JPG", ".JPEG", ".PNG")
MAX_PIXELS = 33_000_000
BASE64_GROWTH = 1.33


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """``(source, splits map<string, array<int>>)`` to ``(source, split, pos, row_idx)``."""
    lists = manifests.select("source", F.explode("splits").alias("split", "__ids"))
    return lists.select("source", "split", F.posexplode("__ids").alias("pos", "row_idx"))


def select_split(
    examples: DataFrame,
    splits: DataFrame,
    name: str,
    limit: int | None = None,
    strict: bool = True,
    known: Sequence[str] = SPLIT_NAMES,
) -> DataFrame:
    """Examples of one split with their list position ``pos``; repeats are kept.

    ``all`` takes every example in source order. Strict: an index outside the source raises;
    otherwise such rows come back with ``found = false``.
    """
    if name == "all":
        out = examples.withColumn("pos", F.col("row_idx")).withColumn("found", F.lit(True))
    elif name not in known:
        raise ValueError(f"unknown split {name!r}; known: {', '.join(known)}, all")
    else:
        wanted = splits.filter(F.col("split") == name).select("pos", "row_idx")
        out = wanted.join(examples.withColumn("found", F.lit(True)), "row_idx", "left").withColumn(
            "found", F.coalesce("found", F.lit(False))
        )
    if strict:
        miss = F.raise_error(F.concat(F.lit("split index out of range: "), F.col("row_idx").cast("string")))
        out = out.withColumn("row_idx", F.when(F.col("found"), F.col("row_idx")).otherwise(miss.cast("bigint"))).drop("found")
    if limit is not None:
        out = page_of(out, [F.col("pos")], 0, limit)
    return out


def audit_splits(splits: DataFrame, examples: DataFrame, known: Sequence[str] = SPLIT_NAMES) -> DataFrame:
    """Violations ``(reason, split, row_idx, n)``; ``row_idx`` stays text so odd values survive.

    Everything but the range check comes from one count per (split, index).
    """
    text = F.col("row_idx").cast("string")
    counts = splits.groupBy("split", text.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("idx", F.col("raw").try_cast("bigint"))
    ok_name = F.col("split").isin(*known)
    per_entry = counts.select(
        "split",
        F.col("raw").alias("row_idx"),
        "n",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~ok_name, "unknown_split"),
                    F.when(F.col("idx").isNull(), "not_an_integer"),
                    F.when(F.col("idx") < 0, "negative_index"),
                    F.when(F.col("n") > 1, "repeated_index"),
                )
            )
        ).alias("reason"),
    )
    ids = examples.select(F.col("row_idx").alias("idx"))
    beyond = (
        counts.filter(F.col("idx") >= 0).join(ids, "idx", "left_anti")
        .select("split", F.col("raw").alias("row_idx"), "n", F.lit("out_of_range").alias("reason"))
    )
    shared = (
        counts.filter(ok_name & F.col("idx").isNotNull())
        .groupBy("idx")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("split")), "+").alias("split"))
        .filter("n > 1")
        .select("split", F.col("idx").cast("string").alias("row_idx"), "n", F.lit("overlap").alias("reason"))
    )
    return per_entry.unionByName(beyond).unionByName(shared).select("reason", "split", "row_idx", "n")


def shape_examples(
    df: DataFrame,
    inputs: Sequence[str],
    input_key: str = "input",
    output_key: str = "output",
    strict: bool = True,
) -> DataFrame:
    """Declared input fields as variant columns plus ``output`` (``{}`` when absent).

    Order of places: key inside the input object, the input itself when it is not an object and
    one field is declared, top-level key. Presence counts, so a JSON null fills a field.
    Strict raises on a missing field; otherwise ``missing`` lists the fields.
    """
    rec = F.col("record")
    given = field(rec, input_key)
    shaped = df
    for name in inputs:
        places = [F.when(is_object(given), field(given, name))]
        if len(inputs) == 1:
            places.append(F.when(given.isNotNull() & ~is_object(given), given))
        places.append(field(rec, name))
        shaped = shaped.withColumn(name, F.coalesce(*places))
    missing = F.filter(
        F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in inputs]), lambda x: x.isNotNull()
    )
    out = shaped.select(
        "row_idx",
        *inputs,
        F.coalesce(field(rec, output_key), F.parse_json(F.lit("{}"))).alias("output"),
        missing.alias("missing"),
        is_object(rec).alias("__object"),
    )
    if not strict:
        return out.drop("__object")
    problem = F.when(~F.col("__object"), "not a JSON object").when(
        F.size("missing") > 0, F.concat(F.lit("missing declared inputs: "), F.array_join("missing", ", "))
    )
    message = F.concat(F.lit("example "), F.col("row_idx").cast("string"), F.lit(": "), problem)
    checked = F.when(problem.isNotNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("row_idx"))
    return out.select(checked.alias("row_idx"), *inputs, "output")


def extract_media_refs(df: DataFrame, col: str, key: str) -> DataFrame:
    """``(key, path, media)`` for every string, at any depth, with a media ending."""
    walked = leaves(df.select(key, col), col).filter(is_string(F.col("leaf")))
    text = F.try_variant_get("leaf", "$", "string")
    return walked.select(key, F.array_join("path", ".").alias("path"), text.alias("media")).filter(
        _any_ending(F.col("media"))
    )


def _any_ending(text):
    hit = F.lit(False)
    for ending in MEDIA_ENDINGS:
        hit = hit | F.endswith(text, F.lit(ending))
    return hit


def media_budget(df: DataFrame, max_mb: float = 3.5, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Flag media over the encoded-size or pixel budget and give the reduced dimensions."""
    pixels = F.col("width") * F.col("height")
    scale = F.when(pixels > max_pixels, F.sqrt(F.lit(float(max_pixels)) / pixels)).otherwise(F.lit(1.0))
    return df.withColumns(
        {
            "over_size": F.col("size_mb") * BASE64_GROWTH > max_mb,
            "over_pixels": pixels > max_pixels,
            "new_width": F.floor(F.col("width") * scale).cast("bigint"),
            "new_height": F.floor(F.col("height") * scale).cast("bigint"),
        }
    )
