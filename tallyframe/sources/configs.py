"""Nested configuration flattening: typed structs by schema, dynamic JSON by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.sources.variants import leaves


def flatten_struct(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Struct fields to columns ``OUTER_INNER``; NULL becomes the empty string. One projection."""

    def walk(schema: T.StructType, ref: str, names: list[str]):
        for f in schema.fields:
            path, here = f"{ref}.`{f.name}`", [*names, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path, here)
            else:
                yield F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_".join(here).upper())

    return df.select(*keep, *walk(df.schema[col].dataType, f"`{col}`", []))


def flatten_json(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dynamic variation: ``(keep.., name, value)`` rows; lists stay whole as JSON text."""
    flat = leaves(df.select(*keep, col), col, into_arrays=False).filter(F.size("path") > 0)
    text = F.coalesce(F.try_variant_get("leaf", "$", "string"), F.to_json("leaf"))
    value = F.when(F.is_variant_null("leaf") | F.col("leaf").isNull(), "").otherwise(text)
    return flat.select(*keep, F.upper(F.array_join("path", "_")).alias("name"), value.alias("value"))
