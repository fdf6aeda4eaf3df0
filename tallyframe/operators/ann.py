"""Nearest neighbours through a candidate index: multi-probe random-hyperplane codes, re-ranked exactly.

Every table of the index orders the training vectors by the signs of their products with random planes. The order is cut
into blocks of ``block_rows`` vectors, and a query looks at the block its own code falls into, at that block's two
neighbours, and at the same for the codes it reaches by flipping the signs it is least sure of. So a query is compared
with a fixed number of vectors whatever the data, crowded codes included, and the work and the shuffle are
linear in the rows. Similarities of what is looked at are exact; what no table shows is missed, which ``recall``
measures against the exact form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyframe.operators.neighbors import best_in_block, knn_demos, unit_rows
from tallyframe.plans.durable import durable
from tallyframe.plans.ordered import CHUNK, Running, first_n, range_chunks, running

#: Planes per table: the length of a code.
PLANES = 48
#: Queries of a block that meet its vectors in one task; more are several tasks.
QUERY_ROWS = 4096


def planes(tables: int, dims: int, seed: int) -> np.ndarray:
    """(tables, PLANES, dims): the same for equal arguments, wherever they are made."""
    return np.random.default_rng(seed).standard_normal((tables, PLANES, dims))


def codes(units: np.ndarray, table: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes): the code of every row, then those with the least sure of its leading signs flipped.

    Only leading planes are flipped: the later ones hardly move a code in the order.
    """
    margins = units @ table.T
    bits = np.int64(1) << np.arange(PLANES - 1, -1, -1)
    own = (margins > 0) @ bits
    lead = np.abs(margins[:, : min(16, PLANES)])
    unsure = np.argsort(lead, axis=1, kind="stable")[:, : max(0, probes - 1)]
    return np.concatenate([own[:, None], own[:, None] ^ bits[unsure]], axis=1)


def _coded(rows: DataFrame, table_planes: np.ndarray, probes: int) -> DataFrame:
    """(id, table, code) of every row, once per table and probe; vectors stay behind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            units = unit_rows(pdf["v"])
            for number, table in enumerate(table_planes):
                found = codes(units, table, probes)
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), found.shape[1]), "table": np.int32(number), "code": found.ravel()})

    return rows.mapInPandas(run, "id bigint, table int, code bigint")


def knn_indexed(
    queries: DataFrame, train: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", tables: int = 8, probes: int = 4, block_rows: int = 1024,
    seed: int = 0, skip_same_id: bool = False,
) -> DataFrame:
    """query_id, neighbor_id, similarity, rank: ``knn_demos`` on what the index shows, ties to the lowest id.

    Equal training vectors are one entry with their ``k + 1`` least ids, so copies do not crowd a block out. With at most
    ``3 * block_rows`` distinct training vectors every table shows all of them and the result is exact. Null vectors are
    left out; a zero vector is orthogonal to everything; empty tables give an empty result.
    """
    shape = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    points, asks = shape(train), shape(queries)
    dims = points.agg(F.max(F.size("v"))).first()[0]
    out = "query_id bigint, neighbor_id bigint, similarity double"
    if not dims:
        return queries.sparkSession.createDataFrame([], f"{out}, rank bigint")
    members = durable(first_n(points, ["v"], [F.col("id")], k + 1).groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "members")
    entries = members.select(F.col("rep").alias("id"), "v")
    table_planes = planes(tables, dims, seed)
    placed = _coded(entries, table_planes, 1).select("id", "table", "code", F.lit(1).alias("entry"))
    looked = _coded(asks, table_planes, probes).select("id", "table", "code", F.lit(0).alias("entry"))
    # One order for both sides: how many entries stand before a row tells its block.
    order = [F.col("code"), F.col("entry"), F.col("id")]
    ranged = range_chunks(placed.unionByName(looked), ["table"], order)
    counted = durable(running(ranged, ["table"], order, F.col(CHUNK), [Running("before", "sum", F.col("entry"), before=True)]).drop(CHUNK), "places")
    block = F.floor(F.coalesce("before", F.lit(0)) / block_rows).cast("int")
    inside = counted.filter("entry = 1").select("id", "table", block.alias("block"))
    blocks = durable(inside.groupBy("table", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    around = F.explode(F.sequence(block - 1, block + 1))
    near = counted.filter("entry = 0").select("id", "table", around.alias("block")).distinct()
    visits = durable(near.join(blocks.drop("n"), ["table", "block"], "left_semi"), "visits")
    load = durable(visits.groupBy("table", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts")), "load")
    left = visits.join(load, ["table", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(asks, "id").select("id", "v", "table", "block", "part")
    right = inside.join(load, ["table", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(entries, "id").select("id", "v", "table", "block", "part")
    group = ["table", "block", "part"]
    wide = k + 1  # the query itself may stand behind one of the entries
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(lambda q, t: best_in_block(q, t, wide), out)
    once = found.groupBy("query_id", "neighbor_id").agg(F.first("similarity").alias("similarity"))
    best = first_n(once, ["query_id"], [F.col("similarity").desc(), F.col("neighbor_id")], wide)
    spread = best.join(members.select(F.col("rep").alias("neighbor_id"), "ids"), "neighbor_id").select("query_id", F.explode("ids").alias("neighbor_id"), "similarity")
    if skip_same_id:
        spread = spread.filter("query_id <> neighbor_id")
    ranked = first_n(spread, ["query_id"], [F.col("similarity").desc(), F.col("neighbor_id")], k, rank="rank")
    return ranked.select("query_id", "neighbor_id", "similarity", F.col("rank").cast("bigint").alias("rank"))


def recall(found: DataFrame, queries: DataFrame, train: DataFrame, k: int, every: int = 100, key: str = "vec_id", vector: str = "embedding", skip_same_id: bool = False) -> DataFrame:
    """One row: ``queries`` measured (ids divisible by ``every``), ``expected`` neighbours, ``hits`` and their ``recall``.

    Each measured query is compared with all training rows. A found neighbour is a hit if it is as similar as the exact
    one of its rank or more, so another of several equally similar rows counts as well.
    """
    asked = queries.filter(F.col(key) % every == 0)
    exact = knn_demos(asked, train, k, key, vector, skip_same_id=skip_same_id).select("query_id", F.col("similarity").alias("true"), "rank")
    both = exact.join(found.select("query_id", "rank", F.col("similarity").alias("got")), ["query_id", "rank"], "left")
    worst = F.min("true").over(W.partitionBy("query_id"))  # k rows a query
    hit = F.col("got") >= F.col("worst")
    return both.withColumn("worst", worst).agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("expected"), F.count(F.when(hit, 1)).alias("hits"),
        (F.count(F.when(hit, 1)) / F.count(F.lit(1))).alias("recall"),
    )
