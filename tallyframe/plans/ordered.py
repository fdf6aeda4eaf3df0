"""Ordered calculations that never put a whole group into one task.

A window over ``partitionBy(key)`` sends every row of a hot key to one task. Here each
group is cut into chunks that follow the order, the window runs inside ``(key, chunk)``,
and a table with one row per chunk carries the running totals from chunk to chunk.

The chunk must be monotone in the order: ``int_chunk`` for unique integer sequences,
``hash_chunk`` for hexadecimal hash orders, ``range_chunks`` for anything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyframe.plans.durable import durable

ROWS_PER_CHUNK = 1 << 18
CHUNK = "__chunk"
GROUP = "__group"


def int_chunk(col: str | Column, rows: int = ROWS_PER_CHUNK) -> Column:
    """Chunks of at most ``rows`` rows for an integer order that is unique in its group (with holes, use ``sparse``)."""
    return F.floor(F.col(col) / rows if isinstance(col, str) else col / rows).cast("bigint")


def time_chunk(col: str | Column, seconds: int) -> Column:
    ts = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds).cast("bigint")


def hash_chunk(hex_col: Column, digits: int = 4) -> Column:
    """Leading digits of a hex digest: equal-sized chunks for a digest order."""
    return F.substring(hex_col, 1, digits)


@dataclass(frozen=True)
class Running:
    """One running value: ``count``, ``sum``, ``max``, ``min`` or ``last`` (skips nulls)."""

    name: str
    kind: str
    value: Column | None = None
    before: bool = False  # leave the current row out


def _fold(kind: str, col: Column) -> Column:
    return {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(col),
        "max": lambda: F.max(col),
        "min": lambda: F.min(col),
        "last": lambda: F.last(col, ignorenulls=True),
    }[kind]()


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    values: Sequence[Running],
    sparse: bool = False,
) -> DataFrame:
    """Add running values per key; equal to an unbounded-preceding window over ``keys``.

    Set ``sparse`` where the chunk follows values that may have holes: a key may then have as many chunks as rows, and
    what is carried from chunk to chunk is bounded by ``prior_totals``. Otherwise a key must have few chunks.
    """
    keys, order = list(keys), list(order)
    slots = [f"__v{i}" for i in range(len(values))]
    # One struct as group key: its NULL parts compare equal, so the window and the join share
    # a single exchange and NULL keys still form groups.
    base = df.withColumn(GROUP, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")))
    for slot, v in zip(slots, values):
        base = base.withColumn(slot, F.lit(1) if v.value is None else v.value)

    # Carry: one row per (key, chunk), partially aggregated before the shuffle.
    totals = base.groupBy(GROUP).agg(
        *[
            (
                F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.struct(*order)))
                if v.kind == "last"
                else _fold(v.kind, F.col(s))
            ).alias(f"__t{i}")
            for i, (s, v) in enumerate(zip(slots, values))
        ]
    )
    folds = {f"__c{i}": ("sum" if v.kind == "count" else v.kind, f"__t{i}") for i, v in enumerate(values)}
    if sparse:
        flat = totals.select(
            *[F.col(f"{GROUP}.k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col(f"{GROUP}.chunk").alias("__at"),
            *[t for _, t in folds.values()],
        )
        names = [f"__k{i}" for i in range(len(keys))]
        told = prior_totals(flat, names, "__at", folds)
        group = F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)], F.col("__at").alias("chunk"))
        carry = told.select(group.alias(GROUP), *folds)
    else:
        earlier = _earlier([f"{GROUP}.k{i}" for i in range(len(keys))], f"{GROUP}.chunk")
        carry = totals.select(GROUP, *[_fold(kind, F.col(t)).over(earlier).alias(c) for c, (kind, t) in folds.items()])

    inside = W.partitionBy(GROUP).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    # Explicit, because data already partitioned by the keys alone could satisfy the window and
    # leave a hot key in one task.
    local = base.repartition(GROUP).select(
        GROUP,
        *df.columns,
        *[
            _fold(v.kind, F.col(s)).over(prior if v.before else upto).alias(f"__l{i}")
            for i, (s, v) in enumerate(zip(slots, values))
        ],
    )
    return local.join(carry, GROUP).select(
        *df.columns,
        *[_merge(v.kind, F.col(f"__c{i}"), F.col(f"__l{i}")).alias(v.name) for i, v in enumerate(values)],
    )


def _earlier(keys: Sequence[str], chunk: str):
    return W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)


#: A window over the chunks of one key takes at most so many; a key with more is carried in two levels.
CARRY_ROWS = 1 << 20


def widest(rows: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most of them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def prior_totals(
    totals: DataFrame, keys: Sequence[str], chunk: str, folds: dict[str, tuple[str, str]], most: int | None = None
) -> DataFrame:
    """Add to a table of one row per (key, chunk) what a key's earlier chunks come to: ``{name: (kind, column)}``.

    The rows are written and counted, unless ``most`` says what ``widest`` found for them. While no key has over CARRY_ROWS of them, one window per key folds them; beyond, they
    are cut into ranges of about CARRY_ROWS rows, so a key has at most rows / CARRY_ROWS ranges to carry in turn.
    Both ways give the same rows; a sum before the first chunk is NULL in one and 0 in the other.
    """
    rows = totals if most is not None and most <= CARRY_ROWS else durable(totals, "totals")
    if (widest(rows, keys) if most is None else most) <= CARRY_ROWS:
        earlier = _earlier(keys, chunk)
        return rows.select(*rows.columns, *[_fold(kind, F.col(t)).over(earlier).alias(c) for c, (kind, t) in folds.items()])
    ranged = range_chunks(rows, keys, [F.col(chunk)], -(-rows.count() // CARRY_ROWS))
    steps = [Running(f"__p{i}", kind, F.col(t), before=True) for i, (kind, t) in enumerate(folds.values())]
    told = running(ranged, keys, [F.col(chunk)], F.col(CHUNK), steps)
    return told.select(*rows.columns, *[F.col(f"__p{i}").alias(c) for i, c in enumerate(folds)])


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], partitions: int | None = None
) -> DataFrame:
    """Add a chunk id for any total order by range-partitioning on (keys, order).

    The range bounds come from a sample, so the chunk ids are written to a table
    once and every later use reads the same ids. Without ``partitions`` the rows are counted first, and a chunk holds
    about ROWS_PER_CHUNK at most. Use ``F.col(CHUNK)`` as the chunk afterwards.
    """
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_CHUNK))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()), "ranges")


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, chunk: Column | None = None
) -> DataFrame:
    """1-based position per key, for groups (or whole tables) of any size."""
    if chunk is None:
        ranged = range_chunks(df, keys, order)
        return running(ranged, keys, order, F.col(CHUNK), [Running(name, "count")]).drop(CHUNK)
    return running(df, keys, order, chunk, [Running(name, "count")])


# Up to here "first n of the whole table" is a top-k in one task; beyond it rows are numbered by many.
TOP_K_ROWS = 10_000


def page_of(df: DataFrame, order: Sequence[str | Column], skip: int, n: int) -> DataFrame:
    """Rows ``skip + 1 .. skip + n`` of the whole table in a unique order, for pages of any depth."""
    if skip + n <= TOP_K_ROWS:
        return df.orderBy(*order).offset(skip).limit(n)
    numbered = row_numbers(df, [], order, "__row")
    return numbered.filter(F.col("__row").between(skip + 1, skip + n)).drop("__row").orderBy(*order)


#: Branches of the tree by which ``first_n`` merges a key: a task gets at most so many times n rows of it.
FAN = 32


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key, for any ``n``, by a tree over where the rows lie.

    Level by level the partitions holding a key are merged ``FAN`` at a time and cut to ``n`` rows again, so a hot key is
    never more than FAN * n rows of one task after the first level, whose tasks each see a share of the input.
    Where Spark prunes a partition before the shuffle it does so at every level.
    """
    name = rank or "__rank"
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__salt", F.spark_partition_id())
    while salts > 1:
        df = df.withColumn("__salt", F.pmod("__salt", F.lit(salts)))
        level = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__r", F.row_number().over(level)).filter(F.col("__r") <= n).drop("__r")
        salts = -(-salts // FAN)
    df = df.drop("__salt")
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)
