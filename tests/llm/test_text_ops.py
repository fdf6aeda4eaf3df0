"""Text operators against plain Python on the small tables and on a table of awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tallyframe.llm import bpe, decontam, fmindex, importance, licenses, neardup, packing, queries, repeats, rules, sharding, suffixes  # noqa: E402
from tallyframe.llm.components import components  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, slot string, rid long, part int, shard string, key int, size int, kept_0 string, term string, __n int"


def _words(n, salt):
    return [f"w{(i * 7919 + salt * 104729) % 9973}" for i in range(n)]


def awkward():
    """Nulls everywhere, empty and wordless texts, ties, repeated rows, copies, passages and a very long text."""
    a, b, passage = _words(120, 1), _words(150, 2), _words(60, 3)
    near = a.copy()
    near[60] = "changed"
    texts = [
        (0, " ".join(a)),
        (1, " ".join(near)),
        (2, " ".join(a)),  # a copy
        (3, " ".join(a)),
        (3, " ".join(a)),  # a repeated row
        (4, None),
        (5, ""),
        (6, " \n\t \x0b"),
        (7, "one two"),
        (8, "one two"),
        (9, " ".join(b[:70] + passage + b[70:])),
        (10, " ".join(_words(50, 4) + passage + _words(40, 5) + passage)),
        (11, "\n".join(["same line here"] * 30)),
        (12, "x" * 70_000),
        (13, " ".join(_words(12_000, 6))),
        (14, "é ü 漢字 🙂 \x1c \x85 <|endoftext|> ½²  don't\n\n" * 3),
        (None, " ".join(passage)),
        (None, " ".join(passage)),
        (None, None),
        (15, "###$$$ a|b <tag> " * 40),
        (16, "MIT License\n" + licenses.MIT.upper().replace("SUBLICENSE", "SUBLICENCE")),
        (17, "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + licenses.ISC.replace(",", " ,")),
        (18, "Some words.\nReleased under the MIT License.\nMore words."),
    ]
    extra = (None, None, 7, "s", 5, 1, "q", 2, 3, "k", "t", 9)
    return [(d, t, None if i % 3 else "en", *extra) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in awkward()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


# --- token counts and packing


def test_pretokens_equal_the_library_below_0530():
    library = Tokenizer.from_file(PATH).pre_tokenizer
    for c in [*range(0x1C), *range(0x20, 0x530)]:
        text = f"a{chr(c)}{chr(c)}1 {chr(c)}b!{chr(c)}! {chr(c)} '{chr(c)}s_{chr(c)}"
        assert not bpe.OTHER.search(text)
        assert bpe.PRETOKEN.findall(text) == [text[i:j] for _, (i, j) in library.pre_tokenize_str(text)], hex(c)


def test_token_counts(spark, sf_dir, odd, none, pairs, docs):
    library = Tokenizer.from_file(PATH)
    for got, texts in ((queries.op1_token_counts(spark, sf_dir), docs), (bpe.count_tokens(odd, PATH), pairs)):
        want = []
        for d, t in texts:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((d, len((t or "").encode()), n, n > 512))
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert bpe.count_tokens(none, PATH).count() == 0


def test_long_texts_are_counted_lazily(monkeypatch):
    counter = bpe.counter(PATH)
    text = "some words, again and again " * 50
    whole = counter.count(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert counter.count(text) == whole


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_packing(spark, sf_dir, odd, none, pairs, docs, which):
    library = Tokenizer.from_file(PATH)
    df, texts = {"documents": (queries.op2_packing(spark, sf_dir), docs), "odd": (packing.pack(odd, PATH), pairs), "none": (packing.pack(none, PATH), [])}[which]
    got = df.collect()
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts]
    assert sum(r.length for r in got) == sum(len(i) for _, i in ids)
    whole = Counter((d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids if len(i) <= 1024)
    pieces = Counter((r.doc_id, r.ids_crc32) for r in got if r.start == 0 and r.length == r.doc_tokens)
    assert all(whole[k] >= n for k, n in pieces.items())
    if which == "documents":
        by_id = dict(ids)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(by_id[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
            assert r.doc_tokens == len(by_id[r.doc_id])
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0 and sorted(filled) == list(range(len(filled)))


def test_hilbert_neighbours_touch(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(packing.hilbert(grid))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


# --- near duplicates


def _class_of(texts, links):
    least = defaultdict(list)
    for (d, _), c in zip(texts, links):
        least[c].append(d)
    return {c: min((d for d in ids if d is not None), default=None) for c, ids in least.items()}


@pytest.mark.parametrize("which", ["documents", "odd", "none", "chain"])
def test_near_duplicates(spark, sf_dir, odd, none, pairs, docs, which):
    chain, base = [], _words(100, 9)
    for i in range(12):  # each is near the next, the ends are far apart
        base = base.copy()
        base[8 * i] = f"new{i}"
        chain.append((100 + i, " ".join(base)))
    texts = {"documents": docs, "odd": pairs, "none": [], "chain": chain}[which]
    df = {"documents": queries.table(spark, sf_dir, "documents"), "odd": odd, "none": none, "chain": spark.createDataFrame(chain, "doc_id long, text string")}[which]
    found, _ = brute.classes(texts)
    least = _class_of(texts, found)
    got = neardup.near_duplicates(df)
    assert rows(got, "doc_id", "class_id") == sorted(((d, least[c]) for (d, _), c in zip(texts, found)), key=repr)
    reps = got.filter("is_representative").select("doc_id", "k1", "k2").distinct().count()
    assert reps == len(least)


def test_leader_rounds_and_leftover_pairs_find_all_links(spark, monkeypatch):
    base = _words(200, 8)
    texts = []
    for i in range(60):
        own = base.copy()
        for j in range(3 + i % 3):
            own[(i * 31 + j * 53) % 200] = f"edit{i}.{j}"
        texts.append((i, " ".join(own)))
    links, _ = brute.classes(texts)
    least = _class_of(texts, links)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(((d, least[c]) for (d, _), c in zip(texts, links)), key=repr)
    for rounds, block in ((0, 2048), (1, 7), (2, 2048)):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert rows(neardup.near_duplicates(df), "doc_id", "class_id") == want


def test_signature_agreement_estimates_weighted_jaccard():
    a, b = _words(400, 1), _words(400, 1)
    b[::40] = _words(10, 77)
    texts = [" ".join(a + a[:100]), " ".join(b + b[:100])]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])])
    doc, cells = neardup.shingle_cells(data, offsets)
    sig = neardup.signatures(doc, cells, 2, k=2048)
    x, y = (Counter(zip(*[t.split()[i:] for i in range(5)])) for t in texts)
    both = sum((x & y).values())
    exact = both / (sum(x.values()) + sum(y.values()) - both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 101)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- quality rules and classifier


def test_measures(spark, sf_dir, odd, none, pairs, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df, texts in ((queries.table(spark, sf_dir, "documents"), docs), (odd, pairs)):
        assert rows(rules.measured(df), *columns) == sorted(((d, *brute.measures(t)) for d, t in texts), key=repr)
    assert rules.measured(none).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 100), (3, 900), (17, 4000), (9, 500)]
    risk = 0.01
    got = spark.createDataFrame(cases, "k int, n int").withColumn("p", rules.binomial_tail(F.col("k"), F.col("n"), risk)).collect()
    for r in got:
        exact = sum(math.comb(r.n, i) * risk**i * (1 - risk) ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact if r.k <= r.n * risk else 1.0, rel=1e-9)


def test_rules_keep_their_promise(spark):
    """Cutoffs chosen on one half reject few clean rows of the other; a small stratum gets no rule."""
    texts, labels = [], []
    for i in range(9000):
        junk = i % 4 == 0
        words = _words(80, i)
        if junk:
            words = [w + "$$$" for w in words]
        texts.append((i, " ".join(words), "en" if i % 100 else "rare"))
        labels.append((i, 0 if junk else 1, 0))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(df, known).collect()
    fresh = [r for r in got if r.doc_id % 2]
    clean = [r for r in got if r.doc_id % 4]
    assert np.mean([r.kept for r in clean]) >= 1 - rules.RISK and fresh
    assert not any(r.kept for r in got if r.doc_id % 4 == 0 and r.doc_id % 100)
    assert all(r.kept for r in got if r.doc_id % 100 == 0)


def test_cutoffs_are_tested_in_order_up_to_the_first_failure(spark):
    """Against plain Python: random chains, null stratum, ties in ``caught``, a chain without clean rows."""
    rng = np.random.default_rng(5)
    cases = [
        (stratum, rule, cutoff, 0 if (stratum, rule) == ("b", "repeat_share") else 2000, 0, int(rng.integers(0, 4)), float(rng.choice([1e-6, 1e-4, 0.004, 0.5], p=[0.6, 0.2, 0.1, 0.1])))
        for stratum in ("a", "b", None)
        for rule, cuts in rules.GRID.items()
        for cutoff in cuts
    ]
    want, limit = {}, rules.DELTA / (3 * len(rules.GRID))
    for stratum, rule, cutoff, n, _, caught, p in sorted(cases, key=lambda c: (str(c[0]), c[1], -c[2])):
        chain = want.setdefault((stratum, rule), {"open": True, "best": None})
        chain["open"] = chain["open"] and n > 0 and p <= limit
        if chain["open"] and caught and (chain["best"] is None or caught > chain["best"][0]):
            chain["best"] = caught, cutoff
    df = spark.createDataFrame(cases, "stratum string, rule string, cutoff double, n int, k int, caught int, p_value double")
    got = {(r.stratum, r.rule): r.cutoff for r in rules.choose_cutoffs(df).collect()}
    assert got == {key: chain["best"][1] for key, chain in want.items() if chain["best"]} and got
    assert rules.choose_cutoffs(df.limit(0)).count() == 0


def test_rules_need_no_more_labels_than_stated(spark):
    """Of four strata the one with 1,495 clean rows, none rejected, gets a cutoff; 1,494 are one too few."""
    p = rules.RISK / len(rules.GRID)
    cases = [(s, r, c, n, 0, 5) for s, n in (("a", 1495), ("b", 1494), ("c", 10), ("d", 10)) for r, cuts in rules.GRID.items() for c in cuts]
    df = spark.createDataFrame(cases, "stratum string, rule string, cutoff double, n int, k int, caught int")
    got = rules.choose_cutoffs(df.withColumn("p_value", rules.binomial_tail(F.col("k"), F.col("n"), p))).collect()
    assert {r.stratum for r in got} == {"a"} and len(got) == len(rules.GRID)


def test_rules_on_awkward_rows(spark, odd, none, pairs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, None), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(odd, labels)
    want = []
    for d, t in pairs:
        n, chars, symbols, dup, repeat = brute.measures(t)
        failed = n < 50 or 100 * repeat > 50 * n
        want.append((d, n, chars, symbols, dup, repeat, failed, not failed))
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=repr)
    assert rules.quality_rules(none, labels).count() == 0


def test_classifier_tells_held_out_rows_apart(spark, sf_dir):
    words = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(1500):
        own = words[i % 5 == 0]
        texts.append((i, " ".join(own[(i * 17 + j * j) % 200] for j in range(60))))
        if i < 800:
            labels.append((i, int(i % 5 != 0), 0))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = importance.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    right = [r.selected == (r.doc_id % 5 != 0) for r in got if r.doc_id >= 800]
    assert len(got) == 1500 and np.mean(right) > 0.98
    some = importance.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=100)
    assert some.filter("selected").count() == 100


def test_classifier_finds_toxic_words_in_long_clean_prose(spark):
    """A few insults among many clean words decide, on held-out and on unlabelled rows, and clean rows stay."""
    texts, labels = [], []
    for i in range(3000):
        toxic = i % 8 == 0
        topic = "abcdefghij"[i // 8 % 10]  # rows of topic j are rarely labelled, so clean ones weigh little
        words = [f"{topic}{(i * 31 + j * j * 7) % 97}" for j in range(200)]
        if toxic:
            words[20], words[90] = f"insult{i % 5}", f"insult{(i // 8) % 5}"
        texts.append((i, " ".join(words)))
        if i < 2000 and (topic != "j" or i % 10 == 1):
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = importance.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    fresh = [r for r in got if r.doc_id >= 2000]
    assert np.mean([not r.selected for r in fresh if r.doc_id % 8 == 0]) > 0.95
    assert np.mean([r.selected for r in fresh if r.doc_id % 8]) > 0.99


def test_cutoff_never_rejects_every_row():
    bad = np.zeros(120, bool)
    assert importance.best_cutoff(np.arange(120.0), bad) == -np.inf
    one = bad.copy()
    one[0] = True
    assert importance.best_cutoff(np.zeros(120), one) == -np.inf
    assert importance.best_cutoff(np.arange(120.0), one) == -np.inf
    assert importance.best_cutoff(np.arange(120.0), one[::-1]) == 118.5


def test_classifier_on_awkward_rows(spark, odd, none, pairs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (15, 0, None), (15, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = importance.resample(odd, labels)
    assert rows(got, "doc_id") == sorted(((d,) for d, _ in pairs), key=repr)
    assert all(r.log_weight == 0 for r in got.filter("n_grams = 0").collect())
    assert importance.resample(odd, labels.limit(0)).filter("selected").count() == len(pairs)
    assert importance.resample(none, labels).count() == 0


# --- licences and shards


def test_licenses(spark, sf_dir, odd, none, pairs, docs):
    got = {r.doc_id: r for r in licenses.scan(odd, licenses.builtin_licenses(spark)).filter("doc_id is not null").collect()}
    assert got[16].license_id == "MIT" and got[17].license_id == "ISC"
    assert got[18].license_id is None and (got[18].n_license_lines, got[18].line_licenses) == (1, "MIT")
    assert got[4].text_digest is None and got[6].text_digest is None and got[0].text_digest == got[2].text_digest
    assert licenses.scan(odd, licenses.builtin_licenses(spark)).count() == len(pairs)
    assert licenses.scan(none, licenses.builtin_licenses(spark)).count() == 0
    nothing = spark.createDataFrame([], licenses.KNOWN_SCHEMA)
    assert licenses.scan(odd, nothing).filter("license_id is not null").count() == 0
    notices = {" ".join(licenses.line_words(t.lower())): name for name, t in licenses.KNOWN if "\n" not in t}
    want = []
    for d, t in docs:
        seen = [notices[n] for x in t.lower().split("\n") if (n := " ".join(licenses.line_words(x))) in notices]
        want.append((d, len(seen), ",".join(sorted(set(seen)))))
    assert rows(queries.op5_licenses(spark, sf_dir), "doc_id", "n_license_lines", "line_licenses") == sorted(want, key=repr)


def test_stored_licenses(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do what you like\nwith this.")
    known = licenses.builtin_licenses(spark, tmp_path)
    texts = [(name, text) for name, text in licenses.stored_licenses() if "\n" in text]
    assert len(texts) == 15
    asked = [*texts, ("Own-1.0", "DO what you like with this"), (None, "Nothing of the kind.")]
    asked += [("GPL-3.0", "GNU General Public License v3.0"), ("BSD-3-Clause", "// SPDX-License-Identifier: BSD-3-Clause")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df, known).collect()}
    assert [got[i] for i in range(len(asked))] == [name for name, _ in asked]


def _placed(df, spark, shards):
    one = sharding.first_map(spark, shards)
    return sharding.place(sharding.assign(df), one, sharding.add_shard(one, shards))


def test_shards(spark, sf_dir, odd, none, pairs, docs):
    for got, texts in ((queries.op6_shards(spark, sf_dir), docs), (_placed(odd, spark, 3), pairs)):
        got = got.collect()
        assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((repr(d), len((t or "").encode()) + 16, brute.crc(t)) for d, t in texts)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        old = max(40 if len(texts) > 100 else 3, 0)
        assert all(r.grown_shard in (r.shard, old) and r.law == "key" for r in got)
        assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})
    assert _placed(none, spark, 3).count() == 0


def test_slot_maps_are_versioned_and_rebalanced(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    one = sharding.first_map(spark, 4, slots=64)
    sharding.store_map(one, path)
    sharding.store_map(sharding.add_shard(one, 4), path)
    two = sharding.load_map(spark, path)
    assert two.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (12, 13) and sharding.load_map(spark, path, 1).count() == 64
    loads = spark.createDataFrame([(i, 100 * (i % 7) + 1) for i in range(60)], "virtual_slot int, bytes long")
    even = sharding.rebalance(two, loads, 5).join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b") / F.min("b")).first()[0]
    assert sharding.rebalance(two, loads, 5).count() == 64 and even < 1.2


# --- repeats and benchmark passages


def test_repeated_passages(spark, sf_dir, odd, none, pairs, docs):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows(queries.op8_substrings(spark, sf_dir), *columns) == sorted(brute.passages(docs), key=repr)
    assert rows(fmindex.remove_repeated_passages(odd), *columns) == sorted(brute.passages(pairs), key=repr)
    assert fmindex.remove_repeated_passages(none).count() == 0


def test_cut_texts_hold_the_kept_words(odd):
    for r in fmindex.remove_repeated_passages(odd, keep=("lang", "slot"), with_text=True).collect():
        assert r.slot == "s"
        assert hashlib.sha256(" ".join(brute.SPACE_WORDS.findall(r.cut_text)).encode()).hexdigest() == r.kept_sha256


def test_repeated_strings(spark, sf_dir, odd, none, pairs, docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(queries.op10_suffix_array(spark, sf_dir), *columns) == sorted(brute.strings(docs), key=repr)
    assert rows(suffixes.remove_repeated_strings(odd), *columns) == sorted(brute.strings(pairs), key=repr)
    assert suffixes.remove_repeated_strings(none).count() == 0


def test_frequent_minimizers_and_small_lots_change_nothing(spark, odd, pairs, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", 2)
    assert rows(fmindex.remove_repeated_passages(odd), "doc_id", "n_removed") == sorted(((x[0], x[2]) for x in brute.passages(pairs)), key=repr)
    assert rows(suffixes.remove_repeated_strings(odd), "doc_id", "n_removed") == sorted(((x[0], x[2]) for x in brute.strings(pairs)), key=repr)


def test_solvers_on_random_texts():
    rng = np.random.default_rng(5)
    for trial in range(20):
        spec = repeats.Spec(k=6, m=2, words=True, within=True)
        texts = [" ".join(rng.choice(["a", "bb", "c"], rng.integers(6, 40))) for _ in range(12)]
        ids, places = rng.integers(0, 6, 12), rng.integers(0, 50, 12)
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        first: dict = {}
        split = [t.split() for t in texts]
        for w, i, p in zip(split, ids, places):
            for j in range(len(w) - 5):
                g = tuple(w[j : j + 6])
                first[g] = min(first.get(g, (99, 99)), (i, p + j))
        want = [first[tuple(w[j : j + 6])] < (i, p + j) for w, i, p in zip(split, ids, places) for j in range(len(w) - 5)]
        assert fmindex.earlier_windows(data, offsets, ids, places, spec).tolist() == want
        spec = repeats.Spec(k=21, m=4, words=False, within=False)
        least: dict = {}
        for r, i in zip(raw, ids):
            for j in range(len(r) - 20):
                least[r[j : j + 21]] = min(least.get(r[j : j + 21], 99), i)
        want = [least[r[j : j + 21]] < i for r, i in zip(raw, ids) for j in range(len(r) - 20)]
        assert suffixes.earlier_strings(data, offsets, ids, places, spec).tolist() == want


def test_decontamination(spark, sf_dir, odd, none, pairs, docs):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = [tuple(r) for r in queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert rows(queries.op9_decontamination(spark, sf_dir), *columns) == sorted(brute.decontaminated(docs, items), key=repr)
    items = [(1, " ".join(_words(60, 3)[5:30]).upper()), (2, "one, TWO!"), (3, None), (4, "..."), (5, "x" * 70_000), (None, "changed"), (7, "same line here same line here same line here same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontam.decontaminate(odd, bench), *columns) == sorted(brute.decontaminated(pairs, items), key=repr)
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity_matches(spark):
    item = _words(10, 3)
    texts = [(1, " ".join(_words(30, 1) + item + _words(30, 2))), (2, " ".join(_words(30, 4) + item[:5] + ["between"] + item[5:])), (3, " ".join(f"q{i}" for i in range(80)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.distance for r in decontam.proximity_matches(docs, bench, slop=2).collect()}
    assert found.get(1) == 0 and 3 not in found


# --- pipeline


def test_pipeline_stages_on_awkward_rows(spark, sf_dir, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, none.select(docs.columns)):
        at = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf_dir)
            assert at.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).count()


def test_pipeline_on_the_small_tables(spark, sf_dir, docs):
    at = queries.table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in at.select("doc_id", "text").collect()]
        at = stage(spark, at, sf_dir)
        seen[name] = (before, [tuple(r) for r in at.select("doc_id", "text").collect()])
    before, after = seen["near_duplicates"]
    found, _ = brute.classes(before)
    assert sorted(d for d, _ in after) == sorted(_class_of(before, found).values())
    before, after = seen["substrings"]
    want = {d: sha for d, _, _, sha in brute.passages(before)}
    assert {d: hashlib.sha256(" ".join(brute.SPACE_WORDS.findall(t)).encode()).hexdigest() for d, t in after} == want
    before, after = seen["decontamination"]
    items = [tuple(r) for r in queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert sorted(d for d, _ in after) == sorted(x[0] for x in brute.decontaminated(before, items) if not x[5])
    labels = {r.doc_id: r for r in queries.table(spark, sf_dir, "labels").collect()}
    before, after = seen["quality_classifier"]
    left = {d for d, _ in after}
    clean = [d in left for d, _ in before if d in labels and labels[d].quality == 1 and not labels[d].toxic]
    assert np.mean(clean) > 0.95


# --- word hashes


def _folded(n):
    """Two unlike words of n signs whose sums of powers are equal modulo 2**64 for any odd base, from n = 1024 on."""
    signs = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return signs, signs.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_equal_sums_of_powers_stay_apart(spark, n):
    rows = [(i, " ".join([w if j == 10 else f"x{j}" for j in range(20)])) for i, w in enumerate(_folded(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of_passages(df) == sorted(brute.passages(rows), key=repr)
    assert [r.class_id for r in neardup.near_duplicates(df).orderBy("doc_id").collect()] == [0, 1]


def rows_of_passages(df):
    return rows(fmindex.remove_repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_word_hashes_differ():
    from tallyframe.llm import words

    texts = ["", "a", "b", "ab", "ba", "a\0", "\0a", "\0", "\0\0", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "y" * 256, "y" * 257, "y" * 300, *_folded(128), *_folded(1024)]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    together = words.word_hashes(data, at[:-1], at[1:])
    assert len(set(together.tolist())) == len(texts)
    for t, h in zip(raw, together):  # the same wherever a word stands
        assert words.word_hashes(np.frombuffer(b"  " + t, np.uint8), np.array([2]), np.array([2 + len(t)]))[0] == h
