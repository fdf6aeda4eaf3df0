"""Ranked search against scores of all documents in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items):
    """{(item, text): [(rank, doc_id, score)]} from scores of all documents."""
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = {}
    for item in set(items):
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(item[1])) if df[t]}
        scored = []
        for (d, _), c in zip(docs, counts):
            m = 10 + 90 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if c[t])
            if s > 0:
                scored.append((-s, math.inf if d is None else d, d))
        scored.sort(key=lambda x: x[:2])
        out[item] = [(i + 1, d, -s) for i, (s, _, d) in enumerate(scored[:10])]
    return sorted(((i, *r) for (i, _), rs in out.items() for r in rs), key=repr)


COLUMNS = ["item_id", "rank", "doc_id", "score"]


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert got(queries.op12_ranked_search(spark, sf_dir)) == ranked(docs, items)


def made():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Æther", "naïve", "漢字", "9"]
    text = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(r.randint(1, 80))) for i in range(150)]
    same = text(30)
    docs += [(1000 - i, same) for i in range(40)] + [(5, docs[5][1]), (5, docs[5][1]), (None, same), (None, None), (900, ""), (901, " -- _ `"), (902, "a1-B2_c3`d4{E5}f6")]
    docs += [(903, "w1 " * 5000), (904, " ".join(f"u{i}" for i in range(20_000)))]
    items = [("a", text(12)), ("a", text(3)), ("b", same), ("b", same), ("c", None), ("d", ""), ("e", "nowhere at all"), (None, "w3 W3 æther ÆTHER naïve"), ("f", "u77 u19999"), ("g", "B2 F6"), ("h", "w0")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_made_rows(spark, monkeypatch, small):
    """Ties, copies beyond ten, repeated rows, nulls, very long texts; also with tiny blocks, groups and steps."""
    if small:
        for name, value in {"BLOCK_DOCS": 16, "FIRST": 12, "STEP_BYTES": 2000, "PIECE_BYTES": 50, "GROUP_BYTES": 3000, "GROUP_TERMS": 8, "CELLS": 64, "LEAST_SLICES": 8, "SLICES_PER_ENTRY": 1}.items():
            monkeypatch.setattr(search, name, value)
    docs, items = made()
    df = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in docs], "doc_id long, text string, rank int, term string, query int, k1 int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int")
    assert got(search.best_documents(df, asked)) == ranked(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "some")], "item_id string, text string")
    assert got(search.best_documents(docs.limit(0), items)) == [] and got(search.best_documents(docs, items.limit(0))) == []
    assert got(search.best_documents(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)) == []
    # A term in every document of one: weight floor(1000 ln(4 / 3)).
    assert got(search.best_documents(docs, items)) == [("a", 1, 1, 287 * (10**9 // 1800))]


def test_bounds_are_never_below_the_score(spark):
    docs, items = made()
    step = search._Step()
    for d, t in docs:
        step.add(d, 0, 0, (t or "").encode())
    counts = [Counter(terms(t)) for _, t in docs if terms(t)]
    size = (len(counts), sum(c.total() for c in counts))
    vocabulary = sorted({t for c in counts for t in c})[:300]
    hashes = np.array([search.term_hash(t.encode()) for t in vocabulary])
    by_id = {}
    for (d, t) in docs:
        if terms(t):
            by_id.setdefault(d or 0, []).append(Counter(terms(t)))
    seen = 0
    for block in step.blocks():
        ids = np.frombuffer(block["ids"], "<i8")
        for part, unit in search.bounds(block, hashes, size):
            for column, d in enumerate(ids[part].tolist()):
                for i, t in enumerate(vocabulary):
                    least = min((c[t] and 10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * size[0] // size[1]))) for c in by_id[d])
                    assert unit[i, column] >= least
                    seen += 1
    assert seen > 10_000


def test_term_hash_is_the_sql_function(spark):
    words = ["a", "w1", "漢字", "x" * 100, "naïve" * 9]
    (row,) = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect()
    assert row.h == [search.term_hash(w.encode()) for w in words]
