"""The classifier against plain Python: models, weights, cutoffs, noise, keys, ranks and the sample."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyframe.llm import importance as im

SEED = 17


def xx(*parts):
    """xxhash64 of a row of values as SQL defines it: each value is hashed with the hash so far as seed, nulls are passed over."""
    h = 42
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else int(p[0]).to_bytes(4, "little") if isinstance(p, tuple) else int(p).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def buckets_of(text):
    return im.gram_buckets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tolist()


def grams(text, memo={}):
    """Buckets of a text's words, neighbouring pairs and lower-cased runs, each piece hashed on its own."""

    def piece(at, s):
        if (at, s) not in memo:
            memo[at, s] = buckets_of(s)[at]
        return memo[at, s]

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    bare = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return [piece(0, w) for w in words] + [piece(2, f"{a} {b}") for a, b in zip(words, words[1:])] + [piece(-1, w.decode()) for w in bare]


def cutoff(weights, clean):
    """The cut with the least loss, of equals the one in the widest gap."""
    pairs = sorted(zip(weights, clean))
    if all(clean) or not any(clean):
        return -math.inf
    last = max(i for i, (_, c) in enumerate(pairs) if c)
    best = None
    for i in range(last + 1):
        gap = pairs[i][0] - pairs[i - 1][0] if i else 0.0
        if i and gap <= 0:
            continue
        loss = im.CLEAN_COST * sum(c for _, c in pairs[:i]) + sum(not c for _, c in pairs[i:])
        if best is None or (loss, -gap) < best[0]:
            best = (loss, -gap), i
    i = best[1]
    return -math.inf if i == 0 else (pairs[i - 1][0] + pairs[i][0]) / 2


def resampled(rows, labels, k=None):
    h = {d: xx(d, (SEED,)) for d, _, _ in labels}
    good, harmless = {d: q == 1 for d, q, _ in labels}, {d: not x for d, _, x in labels}
    fit = {d for d in h if good[d] and harmless[d] and h[d] % 5}
    harmful = {d for d in h if not harmless[d] and h[d] % 5}
    raw, target, docs = Counter(), Counter(), {True: Counter(), False: Counter()}
    for d, t in rows:
        g = grams(t)
        raw.update(g)
        if d in fit:
            target.update(g)
        if d in fit or d in harmful:
            docs[d in harmful].update(set(g))
    share = sum(raw.values()) / max(sum(target.values()), 1)

    def ratio(b):
        r = math.log((target[b] * share + im.PRIOR) / (raw[b] + im.PRIOR))
        return 0.0 if abs(r) < im.LEAST_RATIO or not target else float(np.float32(r))

    def excess(b):
        if not fit or not harmful:
            return 0.0
        r = math.log((docs[True][b] * (len(fit) / len(harmful)) + im.PRIOR) / (docs[False][b] + im.PRIOR))
        return float(np.float32(max(r - im.TOXIC_RATIO, 0)))

    out = []
    for d, t in rows:
        g = grams(t)
        out.append([d, len(g), sum(map(ratio, g)) / max(len(g), 1), sum(map(excess, set(g)))])
    held = [(w, x, good[d], harmless[d]) for d, _, w, x in out if d in h and h[d] % 5 == 0]
    by_quality = [(w, g and s) for w, _, g, s in held if (g and s) or not g]
    by_toxic = [(-x, g and s) for _, x, g, s in held if (g and s) or not s]
    low = cutoff([w for w, _ in by_quality], [c for _, c in by_quality]) if by_quality else -math.inf
    most = cutoff([x for x, _ in by_toxic], [c for _, c in by_toxic]) if by_toxic else -math.inf
    zero = low if low > -math.inf else min(w for _, _, w, _ in out)
    for row in out:
        margin = min(row[2] - zero, -row[3] - most) if most > -math.inf else row[2] - zero
        uniform = (xx(row[0], (SEED,), "gumbel") / 2.0**64 + 0.5) * (1 - 2.0**-50) + 2.0**-51
        row += [margin, margin / im.TEMPERATURE - math.log(-math.log(uniform))]
    k = sum(r[4] >= 0 for r in out) if k is None else k
    chosen = {id(r) for r in sorted(out, key=lambda r: -r[5])[:k]}
    return {r[0]: (r[1], r[2], r[3], r[5], id(r) in chosen) for r in out}, low, most


def corpus(n=600):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(n):
        kind = "bad" if i % 5 == 0 else "good"
        words = [f"{'B' if kind == 'bad' and rng.random() < 0.7 else 'g'}-{rng.integers(0, 40)}" for _ in range(int(rng.integers(20, 60)))]
        if i % 7 == 0:
            words[3], words[9] = f"Insult{rng.integers(0, 3)}", "é漢"
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, int(kind == "good"), int(i % 7 == 0)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "one")], labels


@pytest.mark.parametrize("case, k", [("all", None), ("all", 90), ("no toxic", None), ("no labels", 25)])
def test_sample_equals_plain_python(spark, case, k):
    rows, labels = corpus()
    labels = {"all": labels, "no toxic": [x for x in labels if not x[2]], "no labels": []}[case]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = im.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=k).collect()
    want, low, most = resampled(rows, labels, k)
    assert (low > -math.inf, most > -math.inf) == {"all": (True, True), "no toxic": (True, False), "no labels": (False, False)}[case]
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        n, weight, toxic, key, selected = want[r.doc_id]
        assert (r.n_grams, r.selected) == (n, selected)
        assert (r.log_weight, r.toxic_weight) == pytest.approx((weight, toxic), abs=1e-9)
        assert r.gumbel_key == pytest.approx(key, abs=1e-4)
    if k:
        assert sum(r.selected for r in got) == k
    elif case == "all":
        assert 0 < sum(r.selected for r in got) < len(got)
