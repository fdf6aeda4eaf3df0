"""Traces: listing, observation trees, rollups, sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.exprs import digest_fraction, digest_order
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import CHUNK, Running, page_of, range_chunks, running

def trace_page(
    traces: DataFrame, label: str, page: int = 1, limit: int = 50, environment: str = "environment", ts: str = "timestamp", key: str = "trace_id"
) -> DataFrame:
    """One page of a run's traces, newest first, with total counts and an input preview."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    if page < 1:
        raise ValueError("page starts at 1")
    mine = traces.filter(F.col(environment) == label)
    order = [F.col(ts).desc(), F.col(key)]
    rows = page_of(mine, order, (page - 1) * limit, limit)
    total = mine.agg(F.count(F.lit(1))).scalar()
    text = F.coalesce("input", F.lit(""))
    preview = F.when(F.length(text) > 140, F.concat(F.substring(text, 1, 140), F.lit("…"))).otherwise(text)
    return rows.withColumns({"total_items": total, "preview": preview}).withColumn(
        "total_pages", F.ceil(F.col("total_items") / limit).cast("bigint")
    )


def trace_tree(
    observations: DataFrame, trace: str = "trace_id", obs: str = "obs_id", parent: str = "parent_id", start: str = "start_s", chunks: int | None = None
) -> DataFrame:
    """Depth-first order of every trace: adds ``depth`` and ``position``.

    Siblings go by start time, then id. A trace without roots is a flat list; in a trace with roots,
    observations not reachable from one vanish.

    The tour of a trace enters and leaves every observation once; entering weighs 1, leaving -1. Depth and position are
    sums over the rest of the tour, found by list ranking: each chunk of observations first follows its pointers inside
    itself, then pointers that leave a chunk are doubled in rounds of joins. A row never holds more than one pointer and
    two sums, whatever the depth; a round writes only the pointers that were still open. ``chunks`` sets the number of
    chunks (default: one per ``CHUNK_ROWS`` observations).
    """
    chunks = chunks or max(1, -(-observations.count() // CHUNK_ROWS))
    cols = observations.columns
    rooted = durable(observations.groupBy(trace).agg(F.bool_or(F.col(parent).isNull()).alias("__rooted")), "rooted")
    nodes = observations.join(rooted, trace).select(
        F.col(trace).alias("t"), F.col(obs).alias("o"), F.when(F.col("__rooted"), F.col(parent)).alias("up"), F.struct(F.col(start).alias("s"), F.col(obs).alias("i")).alias("place")
    )
    ranged = range_chunks(nodes, ["t", "up"], [F.col("place").desc()], chunks)
    # Against the order, the least place so far is the next sibling's.
    linked = running(ranged, ["t", "up"], [F.col("place").desc()], F.col(CHUNK), [Running("sibling", "min", F.col("place"), before=True)])
    eldest = ranged.filter("up is not null").groupBy(F.col("t").alias("pt"), F.col("up").alias("po")).agg(F.min("place").alias("eldest"))
    linked = linked.join(eldest, (F.col("t") == F.col("pt")) & (F.col("o") == F.col("po")), "left")
    text = lambda c, name: F.col(c).cast("string").alias(name)
    sent = linked.select(CHUNK, text("t", "t"), text("o", "o"), text("up", "up"), text("sibling.i", "sibling"), text("eldest.i", "child"))
    tour = durable(sent.groupBy(CHUNK).applyInPandas(_followed, _TOUR), "tour")
    asked = tour.filter("no is not null").select("t", F.col("no").alias("o"), F.col("ne").alias("e")).distinct()
    ends = _ranked(tour.join(asked, ["t", "o", "e"], "left_semi")).select("t", F.col("o").alias("no"), F.col("e").alias("ne"), F.col("depth").alias("d2"), F.col("entered").alias("e2"))
    entering = tour.filter("e = 0")
    far = entering.filter("no is not null").join(ends, ["t", "no", "ne"])
    sums = entering.filter("no is null").select("t", "o", "depth", "entered").unionByName(
        far.select("t", "o", (F.col("depth") + F.col("d2")).alias("depth"), (F.col("entered") + F.col("e2")).alias("entered"))
    )
    sums = durable(sums, "sums")
    whole = sums.groupBy(F.col("t").alias("t2")).agg(F.max("entered").alias("n"))
    placed = sums.join(whole, F.col("t") == F.col("t2")).select(
        F.col("t").alias("__t"), F.col("o").alias("__o"), (-F.col("depth")).alias("depth"), (F.col("n") - F.col("entered") + 1).alias("position")
    )
    on = (F.col(trace).cast("string") == F.col("__t")) & (F.col(obs).cast("string") == F.col("__o"))
    return observations.join(placed, on).select(*cols, "depth", "position")


#: Observations of a chunk.
CHUNK_ROWS = 1 << 15
#: A place of the tour (e: 0 enters, 1 leaves), the place its pointer has reached, and the sums up to there.
_TOUR = "t string, o string, e int, no string, ne int, depth bigint, entered bigint"


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The places of one chunk's observations, each pointer followed until it leaves the chunk or ends.

    Rings have neither and are dropped.
    """
    n = len(rows)
    at = {key: i for i, key in enumerate(zip(rows["t"], rows["o"]))}
    t, o = rows["t"].to_numpy(object), rows["o"].to_numpy(object)
    up, sibling, child = ([None if pd.isna(x) else x for x in rows[c]] for c in ("up", "sibling", "child"))
    # Where each place goes: entering to the eldest child or to leaving, leaving to the next sibling or to leaving the parent.
    to = [(c, 0) if c is not None else (own, 1) for c, own in zip(child, o)] + [(s, 0) if s is not None else (u, 1) if u is not None else None for s, u in zip(sibling, up)]
    place = np.arange(2 * n)
    jump = place.copy()
    for i, target in enumerate(to):
        if target is not None and (found := at.get((t[i % n], target[0]))) is not None:
            jump[i] = found + n * target[1]
    stops = jump == place
    depth, entered = np.repeat([1, -1], n), np.repeat([1, 0], n)
    own = depth.copy(), entered.copy()
    depth[stops] = entered[stops] = 0
    for _ in range((2 * n).bit_length()):
        depth, entered, jump = depth + depth[jump], entered + entered[jump], jump[jump]
    reached = np.flatnonzero(stops[jump])
    stop = jump[reached]
    out = [to[i] or (None, None) for i in stop.tolist()]
    return pd.DataFrame({
        "t": t[reached % n], "o": o[reached % n], "e": (reached // n).astype("int32"), "no": [x[0] for x in out], "ne": pd.array([x[1] for x in out], "Int32"),
        "depth": depth[reached] + own[0][stop], "entered": entered[reached] + own[1][stop],
    })


def _ranked(state: DataFrame) -> DataFrame:
    """(t, o, e, depth, entered) of the places whose pointers come to an end, by doubling what is still open."""
    state = durable(state, "state")
    settled, open_ = state.filter("no is null"), state.filter("no is not null")
    while not open_.isEmpty():
        after = settled.unionByName(open_).selectExpr("t", "o as no", "e as ne", "no as no2", "ne as ne2", "depth as d2", "entered as e2")
        moved = open_.join(after, ["t", "no", "ne"]).select(
            "t", "o", "e", F.col("no2").alias("no"), F.col("ne2").alias("ne"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("entered") + F.col("e2")).alias("entered")
        )
        moved = durable(moved, "tour")
        fresh, open_ = moved.filter("no is null"), moved.filter("no is not null")
        if fresh.isEmpty():  # every place within reach of an end would have come nearer: only rings are left
            break
        settled = settled.unionByName(fresh)
    return settled.select("t", "o", "e", "depth", "entered")


def trace_stats(observations: DataFrame, by: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Counts, tokens, errors, cost, latency and span of time per trace, model or type.

    Latency is end minus start of an observation, averaged over those that have ended; the span runs from the first
    start to the last end. ``total_cost`` is null where no observation is priced.
    """
    return observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count(F.when(F.upper("level") == "ERROR", 1)).alias("errors"),
        F.sum("total_cost").alias("total_cost"),
        F.avg(F.col("end_s") - F.col("start_s")).alias("avg_latency_s"),
        (F.max("end_s") - F.min("start_s")).alias("span_s"),
    )


def sample_traces(df: DataFrame, rate: float, seed: int = 0, trace: str = "trace_id") -> DataFrame:
    """Keep a share of traces by id digest: whole traces stay together, reruns keep the same ones."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be in [0, 1]")
    return df.filter(digest_fraction(digest_order(seed, trace)) < rate)
