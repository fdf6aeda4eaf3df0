"""The context tree model against a recursion over dictionaries, and its worth on held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import queries, trees

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(low)


def plain(rows):
    """Scores of (doc_id, text) rows by the formulas, node by node."""
    out_of = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    texts = [b"".join(w + b" " for w in tokens(t)) + b"\n" for _, t in rows]
    count = {}  # (nearest context bytes, decision) -> zeros and ones

    def decisions(text):
        for i, x in enumerate(text):
            ctx = bytes(text[i - 1 - k] if i - 1 - k >= 0 else 0 for k in range(trees.DEPTH))
            for bit in range(8):
                yield ctx, (1 << bit) | (x >> (8 - bit)), x >> (7 - bit) & 1

    for text, out in zip(texts, out_of):
        for ctx, prefix, one in decisions(text):
            for d in range(trees.DEPTH + 1):
                count.setdefault((ctx[:d], prefix), [0, 0])[one] += not out
    below = {}
    for c, prefix in count:
        if c:
            below.setdefault((c[:-1], prefix), []).append((c, prefix))
    value, weight = {}, {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        a, b = count[node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(node[0]) == trees.DEPTH:
            value[node], weight[node] = own, 1.0
        else:
            rest = sum(value[n] for n in below[node])
            top = max(own, rest)
            value[node] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(rest - top))
            weight[node] = 0.5 * math.exp(own - value[node])
    words = Counter(w for (_, t), out in zip(rows, out_of) if not out for w in [*tokens(t), b""])
    n, v = words.total(), len(words)
    result = []
    for (d, t), text, out in zip(rows, texts, out_of):
        score = 0.0
        for ctx, prefix, one in decisions(text):
            p, left = 0.0, 1.0
            for depth in range(trees.DEPTH + 1):
                node = (ctx[:depth], prefix)
                a, b = count[node]
                p += left * weight[node] * (b + 0.5) / (a + b + 1)
                left *= 1 - weight[node]
            score += math.log10(p if one else 1 - p)
        all_words = [*tokens(t), b""]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in all_words)
        result.append((d, out, len(all_words), sum(words[w] > 0 for w in all_words), n, base, score))
    return result


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def same(df, want):
    assert df.columns == COLUMNS
    order = lambda r: (repr(r[:5]), round(r[6], 4))
    got, want = sorted(map(tuple, df.collect()), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def made():
    r = random.Random(1)
    letters = lambda n: "".join(r.choice("abcAB  \n\té漢") for _ in range(n))
    rows = [(i, letters(r.randint(0, 60))) for i in range(25)]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, "Some Words"), (None, None), (50, None), (51, ""), (52, " \n \x0b"), (53, "aaaaaaaaaa" * 20), (54, "x" * 300), (55, "\x00\x00a \x00"), (9, "one\x1ctwo\x85 three")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_the_recursion(spark, monkeypatch, small):
    if small:
        for name, value in {"STEP_BYTES": 7, "BUCKET_ROWS": 40, "SLOT_BYTES": 500}.items():
            monkeypatch.setattr(trees, name, value)
    rows = made()
    df = spark.createDataFrame([(d, t, 1, "w", b"k", 2.0) for d, t in rows], "doc_id long, text string, slot int, word string, key binary, score double").repartition(3)
    same(trees.score(df), plain(rows))


def test_no_training_rows_and_no_rows(spark):
    out = next(i for i in range(100) if trees.held_out(i))
    df = spark.createDataFrame([(out, "ab")], "doc_id long, text string")
    (row,) = trees.score(df).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert math.isclose(row.score, 4 * 8 * math.log10(0.5))
    assert trees.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4094, 4095, 4096, 5000, 10**6, 10**9])
def test_estimates(n):
    for a, b in ((n, 0), (0, n), (n, n // 3)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        # Differences of large logarithms lose their last digits, here and in the library's function.
        assert math.isclose(trees.estimate(np.array([a]), np.array([b]))[0], want, rel_tol=1e-9, abs_tol=1e-9 + 1e-14 * n)


def test_probabilities_of_all_bytes_add_up():
    """After any context the 256 bytes' probabilities make one: the bytes not seen there included."""
    text = [b"the cat sat on the mat and the rat ran"]
    keys, n = trees.held(text, np.array([1]))
    ctx = np.unique(keys >> 8)
    keys_all = (ctx[:, None] << 8 | np.arange(256)).ravel()
    counts = np.zeros(len(keys_all), np.int64)
    counts[np.searchsorted(keys_all, keys)] = n
    levels = trees.Levels(keys_all, counts)
    c, prefix, *_ = levels.top()
    lp = levels.log10(c, prefix, np.zeros(len(c)), np.ones(len(c)))
    np.testing.assert_allclose((10**lp).reshape(-1, 256).sum(1), 1)


def test_query_beats_the_base_on_held_out_rows(spark, sf_dir):
    docs = {tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = queries.op13_lm_scores(spark, sf_dir).select(COLUMNS).collect()
    assert len(got) == queries.table(spark, sf_dir, "documents").count()
    words = Counter(w for d, t in docs if not trees.held_out(d) for w in [*tokens(t), b""])
    assert {r.train_tokens for r in got} == {words.total()}
    by_id = dict(docs)
    for r in got[:50]:
        mine = [*tokens(by_id[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.n_known) == (trees.held_out(r.doc_id), len(mine), sum(words[w] > 0 for w in mine))
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 0.5) / (words.total() + 0.5 * (len(words) + 1))) for w in mine), rel_tol=1e-9)
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert len(out) > 10 and sum(r.score for r in out) / sum(r.n_tokens for r in out) > -6
