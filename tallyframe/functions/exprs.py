"""Column helpers shared by the run, artifact and log tables. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_count(col: str | Column) -> Column:
    """``1,234`` -> 1234; anything else that is not a number -> NULL."""
    return F.regexp_replace(_c(col), ",", "").try_cast("bigint")


def pct(cur: str | Column, total: str | Column, mode: str = "rollouts") -> Column:
    """Percentage at one decimal. ``rollouts``: NULL when either is 0; ``rows``: 0 when total is 0."""
    cur, total = _c(cur), _c(total)
    value = F.round(F.lit(100.0) * cur / F.nullif(total, F.lit(0)), 1)
    if mode == "rollouts":
        return F.when((cur != 0) & (total != 0), value)
    if mode == "rows":
        return F.when(total.isNull() | (total == 0), F.lit(0.0)).otherwise(value)
    raise ValueError(f"unknown mode {mode!r}")


def blank_to_null(col: str | Column) -> Column:
    trimmed = F.regexp_replace(_c(col), r"^\s+|\s+\z", "")
    return F.nullif(trimmed, F.lit(""))


def pick_identity(*cols: str | Column) -> Column:
    """First non-blank identity, trimmed and cut to 256 characters."""
    return F.coalesce(*[F.substring(blank_to_null(c), 1, 256) for c in cols], F.lit("anonymous"))


def run_no(col: str | Column) -> Column:
    """Zero-padded to four digits; wider numbers keep all digits."""
    return F.format_string("%04d", _c(col).cast("bigint"))


def base_stem(col: str | Column) -> Column:
    """File name without directories and without its last extension (a leading dot is no extension)."""
    name = F.regexp_extract(_c(col), r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def strip_base(col: str | Column, base: str) -> Column:
    prefix = base.rstrip("/") + "/"
    return F.when(F.startswith(_c(col), F.lit(prefix)), F.substr(_c(col), F.lit(len(prefix) + 1))).otherwise(_c(col))


def percent_encode(col: Column) -> Column:
    """RFC 3986 percent-encoding of one path segment (form encoding with its three exceptions undone)."""
    encoded = F.url_encode(col)
    for form, strict in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(strict))
    return encoded


def media_url(col: str | Column, base: str) -> Column:
    segments = F.transform(F.split(_c(col), "/"), percent_encode)
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(segments, "/"))


def version_tuple(col: Column) -> Column:
    """All digit runs as an int array, ``[0]`` when there are none; arrays compare like tuples."""
    parts = F.transform(F.regexp_extract_all(col, F.lit(r"(\d+)"), 1), lambda p: p.cast("bigint"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0).cast("bigint")))


# The clause grammar, and for each operator the signs of (version - bound) that it admits.
_CLAUSES = r"(?:^|,)\s*(>=|<=|==|>|<)\s*([0-9][0-9.]*)"
_SIGNS = {">=": (0, 1), "<=": (-1, 0), "==": (0,), ">": (1,), "<": (-1,)}


def compatible(spec: str | Column, version: str) -> Column:
    """Does ``version`` meet every clause of e.g. ``>=0.1,<0.2``? Empty or NULL accepts anything.

    The clauses are read into two arrays, operators and bounds; each bound's sign against the version
    is looked up among the signs its operator admits. A part that is no clause is never met.
    """
    text = F.coalesce(_c(spec), F.lit(""))
    signs = F.create_map(*[x for op, ok in _SIGNS.items() for x in (F.lit(op), F.array(*map(F.lit, ok)))])
    have = version_tuple(F.lit(version))
    operators = F.regexp_extract_all(text, F.lit(_CLAUSES), 1)
    bounds = F.regexp_extract_all(text, F.lit(_CLAUSES), 2)
    sign = lambda bound: F.when(have == bound, 0).when(have > bound, 1).otherwise(-1)
    met = F.zip_with(operators, bounds, lambda op, b: F.array_contains(F.element_at(signs, op), sign(version_tuple(b))))
    parts = F.size(F.filter(F.split(text, ","), lambda part: F.regexp_like(part, F.lit(r"\S"))))
    return (parts == F.size(operators)) & F.forall(met, lambda ok: ok)


def digest_order(seed: int | str, *cols: str | Column) -> Column:
    """Stable pseudo-random order key: md5 of seed and ids, independent of partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]).cast("binary"))


def digest_fraction(digest: Column) -> Column:
    """First 13 hex digits (52 bits, exact in a double) of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def any_prefix(col: str | Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(_c(col), F.lit(p))
    return out
