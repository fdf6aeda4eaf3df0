"""Periodic runs against plain Python: every period of every start, no Lyndon words."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """{(start, length, period)} by comparing words one period apart, for every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the first period found is the smallest
            i = j + 1 if j == i else j
    return sorted((s, l, q) for (s, l), q in found.items())


def smallest_only(found, words):
    """Drops runs whose period is a multiple of a smaller one of the same stretch."""
    return [(s, l, q) for s, l, q in found if not any(q2 < q and words[s : s + l - q2] == words[s + q2 : s + l] for q2 in range(1, q))]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = smallest_only(plain_runs(words), words)
    keep = [True] * n
    for s, l, q in found:
        keep[s + q : s + l] = [False] * (l - q)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def check(df, rows, **kw):
    got = sorted(map(tuple, runs.periodic_runs(df, loop_ids="doc_id", **kw).select(COLUMNS).collect()), key=repr)
    assert got == sorted([expected(d, t) for d, t in rows], key=repr)


def test_query_equals_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, sf_dir).select(COLUMNS).collect()), key=repr)
    assert got == sorted([expected(d, t) for d, t in docs], key=repr)
    assert sum(r[1] > 0 for r in got) >= 5


def made_texts():
    r = random.Random(7)
    words = lambda k, n: " ".join(r.choice("abcdefgh"[:k]) for _ in range(n))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h " * 3, "a b c d e f g h i " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h"]
    texts += [" ".join(fib[-1]), "x " * 300 + "y " + "x " * 300, ("p q " * 30 + "z ") * 5, "é 漢 \x1c " * 20, "q" * 50_000, words(8, 40) + " " + "k l m " * 11 + words(8, 40)]
    texts += [words(k, n) for k in (1, 2, 3) for n in (30, 60, 200)]
    for _ in range(30):  # repeats of repeats, with a word changed here and there
        t = words(4, r.randint(1, 9)).split() * r.randint(2, 9)
        t = (t + words(3, 4).split()) * r.randint(1, 4)
        if r.random() < 0.5:
            t[r.randrange(len(t))] = "!"
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, texts[11]), (None, None), (4, texts[13])]


def test_made_texts(spark, monkeypatch):
    rows = made_texts()
    df = spark.createDataFrame([(d, t, "s", 3, 4, 5) for d, t in rows], "doc_id long, text string, start string, __id int, n_runs int, __text int").repartition(3)
    check(df, rows)
    full = runs.periodic_runs(df, keep=("doc_id", "start"), with_runs=True, with_text=True)
    assert full.columns[:2] == ["doc_id", "start"] and full.columns[-2:] == ["runs", "collapsed_text"]
    for r in full.select("n_runs", "runs", F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("s"), "collapsed_sha256").collect():
        assert len(r.runs) == r.n_runs and r.s == r.collapsed_sha256
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_pieces_and_steps_change_nothing(spark, monkeypatch):
    known, other = {}, {}
    text = b" a bb  ccc\n" * 50
    whole = runs.word_numbers(text, known)
    monkeypatch.setattr(runs, "PIECE_BYTES", 7)
    monkeypatch.setattr(runs, "PIECE_WORDS", 3)
    assert runs.word_numbers(text, other).tolist() == whole.tolist() and known == other
    assert runs.joined_sha256(whole, list(known)) == hashlib.sha256(b" ".join(text.split())).hexdigest()


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_lyndon_lengths(letters):
    r = random.Random(letters)
    for n in [1, 2, 3, 7, 20, 60]:
        for _ in range(40):
            s = [r.randrange(letters) for _ in range(n)]
            want = []
            for i in range(n):
                want.append(next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i)
            assert runs.lyndon_lengths(np.array(s)).tolist() == want


def test_long_text(spark):
    """A million words with one period, another million without: in proportion to the words, no recursion."""
    n = 1_000_000
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(F.repeat(F.lit("a b b a c "), n // 5), F.expr(f"array_join(transform(sequence(1, {n // 4}), i -> concat('w', i)), ' ')")).alias("text"))
    (row,) = runs.periodic_runs(df).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, n, 5)
