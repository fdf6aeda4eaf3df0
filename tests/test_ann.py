"""The candidate index against the exact form: recall, copies, bounds."""

from __future__ import annotations

import numpy as np
import pytest

from tallyframe.operators import ann, neighbors as nb


def frame(spark, vecs):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "neighbor_id", "similarity").collect()))


def clustered(n, dims, centres, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))


def test_one_block_is_exact_with_copies_and_odd_vectors(spark):
    vecs = clustered(150, 8, 6, 0)
    vecs[50:90] = vecs[3]  # more copies than k
    vecs[100:103] = 0
    df = frame(spark, vecs).unionByName(spark.createDataFrame([(900, None)], "vec_id bigint, embedding array<double>"))
    known = df.filter("embedding is not null")
    for k in (1, 5, 20):
        assert rows(ann.knn_indexed(df, df, k, skip_same_id=True)) == rows(nb.knn_demos(known, known, k, skip_same_id=True))
    assert rows(ann.knn_indexed(df, df, 3)) == rows(nb.knn_demos(known, known, 3))
    assert ann.knn_indexed(df, df.limit(0), 3).count() == 0 and ann.knn_indexed(df.limit(0), df, 3).count() == 0


def test_recall_over_many_blocks(spark):
    """3,000 vectors in blocks of 64: a query sees a part of them, similarities are exact, recall is 0.9 or more."""
    vecs = clustered(3000, 24, 60, 1, 0.35)
    vecs[1000:1400] = vecs[0]  # one group of copies over many blocks, if they were not one entry
    df = frame(spark, vecs)
    found = ann.knn_indexed(df, df, 5, block_rows=64, skip_same_id=True).cache()
    (measured,) = ann.recall(found, df, df, 5, every=10, skip_same_id=True).collect()
    assert measured.queries == 300 and measured.expected == 1500 and measured.recall >= 0.9
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for r in found.filter("query_id % 50 = 7").collect():
        assert abs(r.similarity - round(float(unit[r.query_id] @ unit[r.neighbor_id]), 6)) < 2e-6


def test_codes_flip_the_least_sure_leading_planes():
    units = nb.unit_rows(__import__("pandas").Series([[1.0, 0.0, 0.2]]))
    table = ann.planes(1, 3, 0)[0]
    found = ann.codes(units, table, 4)[0]
    own = sum(int(m > 0) << (ann.PLANES - 1 - i) for i, m in enumerate(units[0] @ table.T))
    assert found[0] == own
    margins = np.abs(units[0] @ table.T)[:16]
    assert [int(own ^ f).bit_length() for f in found[1:]] == [ann.PLANES - i for i in np.argsort(margins, kind="stable")[:3]]


@pytest.mark.parametrize("k", [64, 200])
def test_sketched_running_median(spark, k):
    from pyspark.sql import functions as F

    from tallyframe.plans.running_median import rank_error, running_median_sketch

    n = 3000
    df = spark.range(n).select((F.col("id") % 2).alias("run"), F.col("id").alias("seq"), ((F.col("id") * 7919 % 3001) / 7).alias("x"))
    got = running_median_sketch(df, "run", "seq", "x", "m", k, rows_per_block=500).orderBy("run", "seq").collect()
    assert len(got) == n
    off, seen = [], {0: [], 1: []}
    for r in sorted(got, key=lambda r: r.seq):
        values = seen[r.run]
        values.append(r.seq * 7919 % 3001 / 7)
        low, high = sum(v < r.m for v in values), sum(v <= r.m for v in values)
        off.append(max(0, low - len(values) / 2 - 1, len(values) / 2 - high - 1) / len(values))
    assert np.quantile(off, 0.97) <= rank_error(k)


def shuffled(plan):
    """Rows that the exchanges under an executed adaptive plan wrote."""
    leaves, total = plan.collectLeaves(), 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = leaf.plan()
            if inner.getClass().getSimpleName() == "ShuffleExchangeExec":
                total += inner.metrics().apply("shuffleRecordsWritten").value()
            total += shuffled(inner)
    return total


def test_exact_form_shuffles_a_vector_once_a_block(spark):
    """Far vectors rule no cell out: 1,200 vectors and 64 block pairs are some 10 copies a side, not one per pivot and block."""
    vecs = np.random.default_rng(2).normal(size=(1200, 16))
    df = frame(spark, vecs)
    found = nb.knn_demos(df, df, 5, block_rows=16, skip_same_id=True)
    plan = found._jdf.queryExecution().executedPlan()
    got = plan.execute().count()
    assert got == 6000
    moved = shuffled(plan.executedPlan())
    assert 0 < moved < 1200 * 100, moved
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sim, -np.inf)
    want = [(q, r + 1, int(t), sim[q, t]) for q in range(1200) for r, t in enumerate(np.lexsort((np.arange(1200), -sim[q]))[:5])]
    assert [r[:3] for r in rows(found)] == [r[:3] for r in sorted(want)]


@pytest.mark.parametrize("tile", [(256, 2048), (7, 11), (3, 2)])
def test_tiles_agree_with_the_whole_block(tile, monkeypatch):
    """Ties, copies, repeated ids on both sides and parts that only some queries look at."""
    import pandas as pd

    monkeypatch.setattr(nb, "TILE", tile)
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(90, 4)).round(1)
    vecs[20:50], vecs[60:63] = vecs[0], 0
    ids = rng.permutation(90) // 2
    q = pd.DataFrame({"id": ids[:60], "v": list(vecs[:60].astype("float32")), "parts": rng.integers(0, 8, 60)})
    t = pd.DataFrame({"id": ids[15:], "v": list(vecs[15:].astype("float32")), "part": rng.integers(0, 3, 75)})
    sim = np.round(nb.unit_rows(q["v"]) @ nb.unit_rows(t["v"]).T, 6)
    for k in (1, 4, 100):
        for skip in (False, True):
            for looks in (True, False):
                want = {}
                for i, a in enumerate(q.itertuples()):
                    some = [(-sim[i, j], b.id) for j, b in enumerate(t.itertuples()) if (a.parts >> b.part & 1 or not looks) and not (skip and a.id == b.id)]
                    want[a.id] = sorted(want.get(a.id, []) + sorted(some)[:k])[:k]
                got = nb.best_in_block(q if looks else q.drop(columns="parts"), t, k, skip)
                assert sorted(zip(got.query_id, -got.similarity, got.neighbor_id)) == sorted((i, *x) for i, some in want.items() for x in some)


def test_pivots_share_a_cell_up_to_a_block():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 90, 500)
    cell, part = nb._cells(rng.normal(size=(500, 6)), counts, 2000)
    members, pivots = np.bincount(cell, counts), np.bincount(cell)
    assert members.max() <= 2000 and pivots.max() <= nb.PARTS and len(pivots) < 30
    assert len(set(zip(cell, part))) == 500 and part.max() < nb.PARTS
    assert (np.bincount(nb._cells(np.zeros((300, 6)), np.ones(300, dtype=int), 10**6)[0]) <= nb.PARTS).all()
    assert len(set(nb._cells(rng.normal(size=(9, 6)), np.full(9, 50), 0)[0])) == 9
