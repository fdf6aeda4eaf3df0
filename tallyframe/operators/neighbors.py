"""Exact k nearest neighbours by cosine, as a pruned block join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from tallyframe.functions.exprs import digest_order
from tallyframe.plans.ordered import TOP_K_ROWS, first_n

DECIMALS = 6  # similarities are rounded, so ties are well defined
# Covers the rounding of similarities (squared distance moves by 2 per unit) and float error.
_SLACK = 2 * 2 * 10.0**-DECIMALS

#: Queries that are held against all pivots at once, and rows of a frame of visits.
VISIT_ROWS = 2048
#: Doubles of a block's vectors and best lists: what bounds a block, and with it how often a vector is shuffled.
BLOCK_BYTES = 32 << 20
#: Block pairs there should be at least, unless blocks would fall below ``block_rows``.
PAIRS = 64
#: Queries and training rows whose similarities are held at once.
TILE = (256, 2048)
#: Pivots of a cell at most: the bits of ``parts``.
PARTS = 62


def unit_rows(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _gap(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances between unit vectors; a zero vector counts as orthogonal to everything."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def best_in_block(q: pd.DataFrame, t: pd.DataFrame, k: int, skip_same_id: bool = False) -> pd.DataFrame:
    """The ``k`` best training rows of one block for every query of one block.

    Where a query has ``parts``, it is held against training rows whose ``part`` is a bit set there, otherwise against all.
    """
    empty = pd.DataFrame({"query_id": [], "neighbor_id": [], "similarity": []}).astype(
        {"query_id": "int64", "neighbor_id": "int64", "similarity": "float64"}
    )
    if q.empty or t.empty:
        return empty
    t = t.sort_values("id", kind="stable")  # a row's position then decides ties
    qid, tid = q["id"].to_numpy(), t["id"].to_numpy()
    asks, units = unit_rows(q["v"]), unit_rows(t["v"])
    best = np.full((len(q), min(k, len(t))), -np.inf)
    at = np.full(best.shape, len(t))
    part = t["part"].to_numpy() if "parts" in q else np.zeros(len(t), dtype=np.int64)
    parts = q["parts"].to_numpy() if "parts" in q else np.ones(len(q), dtype=np.int64)
    for p in np.unique(part):
        _hold(asks, units, qid, tid, np.flatnonzero(parts >> p & 1), np.flatnonzero(part == p), best, at, skip_same_id)
    rows, cols = np.nonzero(best > -np.inf)
    found = pd.DataFrame({"query_id": qid[rows], "neighbor_id": tid[at[rows, cols]], "similarity": best[rows, cols]})
    found = found.sort_values(["query_id", "similarity", "neighbor_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _hold(asks, units, qid, tid, mine: np.ndarray, theirs: np.ndarray, best: np.ndarray, at: np.ndarray, skip_same_id: bool) -> None:
    """Hold queries ``mine`` against training rows ``theirs``, tile by tile, and keep what is better than ``best`` at ``at``."""
    k, half = best.shape[1], 0.6 * 10.0**-DECIMALS  # rounding moves a similarity by less
    room, marks = np.empty(TILE[0] * TILE[1]), np.empty(TILE[0] * TILE[1], dtype=bool)
    for j in range(0, len(theirs), TILE[1]):
        cols = theirs[j : j + TILE[1]]
        columns, ids = units[cols].T, tid[cols]
        for i in range(0, len(mine), TILE[0]):
            rows = mine[i : i + TILE[0]]
            shape = len(rows), len(cols)
            sim = np.matmul(asks[rows], columns, out=room[: shape[0] * shape[1]].reshape(shape))
            if skip_same_id:
                low, high = np.searchsorted(ids, qid[rows]), np.searchsorted(ids, qid[rows], "right")
                for r in np.flatnonzero(low < high):
                    sim[r, low[r] : high[r]] = -np.inf
            kth = best[rows, -1]
            floor = np.maximum(kth - half, -2.0)  # below any similarity, above what is skipped
            if np.isneginf(kth).any() and shape[1] >= k:
                floor = np.fmax(floor, -np.partition(-sim, k - 1, axis=1)[:, k - 1] - 2 * half)
            over = np.greater_equal(sim, floor[:, None], out=marks[: sim.size].reshape(shape))
            r, c = np.divmod(np.flatnonzero(over), shape[1])
            s, c = np.round(sim[r, c], DECIMALS), cols[c]
            better = (s > kth[r]) | ((s == kth[r]) & (c < at[rows[r], -1]))
            if better.any():
                _merge(best, at, rows[r[better]], s[better], c[better])


def _merge(best: np.ndarray, at: np.ndarray, rows: np.ndarray, sim: np.ndarray, cols: np.ndarray) -> None:
    """Put candidates into the sorted best lists of their rows."""
    k = best.shape[1]
    hit, group = np.unique(rows, return_inverse=True)
    group = np.concatenate([np.repeat(np.arange(len(hit)), k), group])
    sim, cols = np.concatenate([best[hit].ravel(), sim]), np.concatenate([at[hit].ravel(), cols])
    order = np.lexsort((cols, -sim, group))
    first = np.searchsorted(group[order], np.arange(len(hit)))
    take = order[first[:, None] + np.arange(k)]
    best[hit], at[hit] = sim[take], cols[take]


def knn_demos(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 4096,
    pivots: int | None = None,
    skip_same_id: bool = False,
) -> DataFrame:
    """Exact k nearest training vectors for every query, ties to the lowest id.

    ``skip_same_id`` is for queries taken from the training rows themselves: equal ids are then one row,
    which is no neighbour of itself. Otherwise ids of the two tables have nothing to do with each other.

    Training vectors belong to their nearest pivot, and neighbouring pivots share a cell while it is no larger than a block. A query
    visits only cells with a pivot that the triangle inequality cannot rule out, and is held against those pivots' members only: its
    k-th neighbour is no farther than the best sums of (query to pivot) and (pivot to one of its nearest members). Cells and
    their visitors are hashed into blocks, so a crowded cell is many tasks; a pair of blocks is compared in small tiles
    and emits only its best ``k``, and those short lists are merged.

    A vector is shuffled once per block it is held against. So blocks are as large as PAIRS pairs (four a core, if more) allow, but no larger than
    BLOCK_BYTES: up to there the shuffle grows with the rows, beyond with their square over the block's rows. Blocks are never
    made smaller than ``block_rows``.

    Without ``pivots`` there are as many as the square root of the training rows, but no more than blocks of ``block_rows``. Only the pivots,
    ``k + 1`` distances per pivot and counts pass through the driver. Where pruning rules little out this form compares all
    pairs; ``ann.knn_indexed`` does not.
    """
    points, asks = _vectors(train, key, vector), _vectors(queries, key, vector)
    n_train, dims = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asks, cores = asks.count(), train.sparkSession.sparkContext.defaultParallelism
    even = math.ceil(math.sqrt(n_train * n_asks / max(PAIRS, 4 * cores)))
    wide = max(block_rows, min(even, BLOCK_BYTES // (8 * (max(dims or 0, 1) + 2 * k))))
    count = min(pivots or math.ceil(math.sqrt(n_train)), math.ceil(n_train / block_rows))
    if count <= 1:
        placed = points.withColumns({"cell": F.lit(0), "part": F.lit(0)})
        visits, sizes = asks.withColumns({"cell": F.lit(0), "parts": F.lit(1).cast("bigint")}), {0: (n_train, n_asks)}
    else:
        placed, visits, sizes = _prune(asks, points, k, count, wide)

    t_blocks, q_blocks = ([max(1, math.ceil(sizes[c][side] / wide)) for c in range(len(sizes))] for side in (0, 1))
    of_cell = lambda counts: F.get(F.array(*[F.lit(c) for c in counts]), F.col("cell"))
    mine = lambda counts: F.pmod(F.xxhash64(F.lit("block"), "id"), of_cell(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), of_cell(counts) - 1))
    left = visits.select("id", "v", "parts", "cell", mine(q_blocks).alias("qb"), every(t_blocks).alias("tb"))
    right = placed.select("id", "v", "part", "cell", mine(t_blocks).alias("tb"), every(q_blocks).alias("qb"))
    pair = ["cell", "qb", "tb"]
    partial = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(
        lambda q, t: best_in_block(q, t, k, skip_same_id), "query_id bigint, neighbor_id bigint, similarity double"
    )
    order = [F.col("similarity").desc(), F.col("neighbor_id")]
    if k * sum(t_blocks) <= TOP_K_ROWS:  # so many rows an id at most, as a training block is met once
        best = partial.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    else:
        best = first_n(partial, ["query_id"], order, k, rank="rank")
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): single precision stays as it is, since tasks compute in double anyway."""
    out = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = out.schema["v"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return out if single else out.withColumn("v", F.col("v").cast("array<double>"))


def _slices(frames):
    for whole in frames:
        for at in range(0, len(whole), VISIT_ROWS):
            yield whole.iloc[at : at + VISIT_ROWS]


def _reach(units: np.ndarray, centres, cells, radius, near_cell, near_gap, k: int, bits):
    """(rows, cells, parts): which cells every query must visit, and there the bits of the pivots it must."""
    gap = _gap(units, centres)
    # k + 1, because the query itself may be among the members
    reach = gap[:, near_cell] + near_gap
    bound = np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(units), np.inf)
    least = np.maximum(0.0, gap - radius - 1e-6)
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    parts = np.add.reduceat(np.where(least**2 <= (bound**2 + _SLACK)[:, None], bits, 0)[:, order], starts, axis=1)
    rows, cols = np.nonzero(parts)
    return rows, found[cols], parts[rows, cols]


def _visits(frames, centres: np.ndarray, cells: np.ndarray, radius: np.ndarray, near_cell: np.ndarray, near_gap: np.ndarray, k: int, bits: np.ndarray | int = 1):
    """Every query with each cell it must visit, ``VISIT_ROWS`` rows a frame at most: a query may have as many as there are cells.

    ``cells`` and ``bits`` are those of the pivots, ``near_cell`` counts pivots.
    """
    for pdf in _slices(frames):
        rows, found, parts = _reach(unit_rows(pdf["v"]), centres, cells, radius, near_cell, near_gap, k, bits)
        for i in range(0, len(rows), VISIT_ROWS):
            some = slice(i, i + VISIT_ROWS)
            yield pdf.iloc[rows[some]].reset_index(drop=True).assign(cell=found[some].astype("int32"), parts=parts[some].astype("int64"))


def _cells(centres: np.ndarray, counts: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and part of every pivot: neighbours share a cell while it has ``wide`` members and PARTS pivots at most."""
    order, open_ = [], [np.arange(len(centres))]
    while open_:
        some = open_.pop()
        if len(some) == 1:
            order.append(some[0])
            continue
        axis = np.ptp(centres[some], axis=0).argmax()
        some = some[np.argsort(centres[some, axis], kind="stable")]
        open_ += [some[len(some) // 2 :], some[: len(some) // 2]]
    cell, part = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
    number, held, members = 0, 0, 0
    for p in order:
        if held and (held == PARTS or members + counts[p] > wide):
            number, held, members = number + 1, 0, 0
        cell[p], part[p] = number, held
        held, members = held + 1, members + counts[p]
    return cell, part


def _prune(asks: DataFrame, points: DataFrame, k: int, pivots: int, wide: int = 0) -> tuple[DataFrame, DataFrame, dict[int, tuple[int, int]]]:
    """Training rows with their cell and part, query rows with every cell they must visit, and of each cell its rows and visitors."""
    nonzero = points.filter(F.exists("v", lambda x: x != 0))
    sample = nonzero.orderBy(digest_order(0, "id")).limit(pivots).select("v").collect()  # ``pivots`` rows
    if not sample:
        placed = points.withColumns({"cell": F.lit(0), "part": F.lit(0)})
        return placed, asks.withColumns({"cell": F.lit(0), "parts": F.lit(1).cast("bigint")}), {0: (points.count(), asks.count())}
    centres = unit_rows(pd.Series([r["v"] for r in sample]))

    def assign(frames):
        for pdf in _slices(frames):
            gap = _gap(unit_rows(pdf["v"]), centres)
            yield pd.DataFrame({"pivot": gap.argmin(axis=1).astype("int32"), "gap": gap.min(axis=1)})

    narrow = points.select("v").mapInPandas(assign, "pivot int, gap double")
    shape = {r["pivot"]: (r["n"], r["radius"]) for r in narrow.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}
    nearest = first_n(narrow, ["pivot"], [F.col("gap")], k + 1).collect()  # k + 1 rows per pivot
    used = np.array(sorted(shape))
    counts, radius = np.array([shape[p][0] for p in used]), np.array([shape[p][1] for p in used])
    near_cell = np.searchsorted(used, [r["pivot"] for r in nearest])
    near_gap = np.array([r["gap"] for r in nearest])
    cells, parts = _cells(centres[used], counts, wide)
    bits = np.int64(1) << parts
    cell_of, part_of = (np.zeros(len(centres), dtype="int32") for _ in range(2))
    cell_of[used], part_of[used] = cells, parts

    def place(frames):
        for pdf in _slices(frames):
            own = _gap(unit_rows(pdf["v"]), centres).argmin(axis=1)
            yield pdf.assign(cell=cell_of[own], part=part_of[own])

    def visit(frames):
        return _visits(frames, centres[used], cells, radius, near_cell, near_gap, k, bits)

    def load(frames):
        n = np.zeros(cells.max() + 1, dtype=np.int64)
        for pdf in _slices(frames):
            n += np.bincount(_reach(unit_rows(pdf["v"]), centres[used], cells, radius, near_cell, near_gap, k, bits)[1], minlength=len(n))
        yield pd.DataFrame({"cell": np.arange(len(n), dtype="int32"), "n": n})

    typed = lambda df: f"id bigint, v {df.schema['v'].dataType.simpleString()}"
    placed = points.mapInPandas(place, f"{typed(points)}, cell int, part int")
    visits = asks.mapInPandas(visit, f"{typed(asks)}, cell int, parts bigint")
    visitors = dict(asks.select("v").mapInPandas(load, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect())
    return placed, visits, {c: (int(counts[cells == c].sum()), visitors.get(c, 0)) for c in range(cells.max() + 1)}
