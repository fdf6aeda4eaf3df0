"""Quality rules whose cutoffs are chosen under a proven limit on false rejections.

Method: each rule rejects texts whose measure is at or above a cutoff. On labelled holdouts every (stratum,
rule, cutoff) is tested with the exact binomial tail: if clean documents were rejected with
probability ``risk`` or more, so few rejections would have had at most the p-value's chance. The cutoffs of one rule in
one stratum are tested in a fixed order, the one that rejects fewest first, up to the first that fails; so only the number of
(stratum, rule) chains needs Bonferroni's correction, not that of all cutoffs. Among the cutoffs passed the one that
rejects most bad documents is taken. Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyframe.plans.durable import durable

# Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Share of clean documents of a stratum that all rules together may reject, and the chance of a wrong choice.
RISK, DELTA = 0.02, 0.05
#: Measures of the rules; each rejects at or above a cutoff of its grid.
GRID = {
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5],
    "dup_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_share": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "shortness": [0.001, 0.002, 0.005, 0.01, 0.015, 0.02],
}


def measured(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    Words are runs of characters other than blank and controls 9 to 13. A null text is empty. The words of a
    window found twice are counted by sorting the text's windows (hash first, then the words
    themselves, so equal hashes of different words cannot mislead) and comparing neighbours; a text's
    arrays stay in its row and nothing is shuffled.
    """
    keep = list(keep)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.select(*keep, t.alias("__t"), F.btrim(t, F.lit(SPACES)).alias("__b"))
    words = F.when(F.col("__b") != "", F.split("__b", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(*keep, "__t", words.alias("__w"), lines.alias("__l"))
    n = F.size("__w")
    df = df.select(
        *keep,
        "__w",
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.greatest(n - F.lit(WINDOW - 1), F.lit(0)).alias("__m"),
    )
    gram = F.arrays_zip(*[F.slice("__w", i + 1, F.col("__m")).alias(f"w{i}") for i in range(WINDOW)])
    keyed = F.transform(gram, lambda g, i: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i")))
    df = df.withColumn("__s", F.sort_array(keyed))
    last = F.greatest(F.col("__m") - 1, F.lit(0))
    same = F.zip_with(
        F.slice("__s", 1, last), F.slice("__s", 2, last), lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    )
    df = df.withColumn("__e", same).drop("__w")
    no = F.array(F.lit(False))
    twice = F.zip_with(F.concat(no, "__e"), F.concat("__e", no), lambda a, b: a | b)
    # A text without windows has no entry in __s and one in ``twice``; the filter drops what has no position.
    place = F.zip_with("__s", twice, lambda s, d: F.when(d, s["i"]))
    df = df.withColumn("__p", F.sort_array(F.filter(place, lambda x: x.isNotNull())))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "__p",
        start,
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).cast("long").alias("n")),
        lambda acc: acc["n"],
    )
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_measures(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
            "shortness": F.when(F.col("n_words") > 0, 1 / F.col("n_words")).otherwise(F.lit(1.0)),
        }
    )


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k), exactly: terms are summed by their ratios, in logarithms so that none is lost.

    Above the mean the tail is no proof of anything, so 1 is given without summing.
    """
    odds = math.log(risk / (1 - risk))
    first = n * F.lit(math.log(1 - risk))
    zero = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    summed = F.exp(F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), zero, step)["total"])
    return F.when(k > n * F.lit(risk), F.lit(1.0)).otherwise(summed)


def tests_of(holdout: DataFrame, stratum: str, risk: float = RISK) -> DataFrame:
    """(stratum, rule, cutoff, n, k, caught, p_value) for every cutoff, from clean and bad labelled rows past the base rule.

    Counting is per (stratum, rule, cutoff) with partial sums before the shuffle: rows of a hot stratum are
    never gathered.
    """
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) >= c).alias("out")) for r, cuts in GRID.items() for c in cuts])
    each = holdout.select(F.col(stratum).alias("stratum"), "clean", F.explode(grid).alias("t")).select("stratum", "clean", "t.*")
    counted = each.groupBy("stratum", "rule", "cutoff").agg(
        F.sum(F.col("clean").cast("int")).cast("int").alias("n"),
        F.sum((F.col("clean") & F.col("out")).cast("int")).cast("int").alias("k"),
        F.sum((~F.col("clean") & F.col("out")).cast("int")).cast("int").alias("caught"),
    )
    return counted.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), risk / len(GRID)))


def choose_cutoffs(tests: DataFrame, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the safe cutoff that catches most, the highest of equals; chains without one are absent.

    A cutoff is safe if it and all higher ones of its (stratum, rule) have a p-value of at most ``delta`` over the number of
    chains: a wrong one is only reached through the first wrong one of its chain, so no more than one error a chain is
    at stake. A chain has as many rows as its rule has cutoffs.
    """
    chains = max(tests.select("stratum", "rule").distinct().count(), 1)
    down = W.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc()).rowsBetween(W.unboundedPreceding, 0)
    failed = ((F.col("n") == 0) | (F.col("p_value") > delta / chains)).cast("int")
    safe = tests.withColumn("failed", F.max(failed).over(down)).filter((F.col("failed") == 0) & (F.col("caught") > 0))
    return safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("caught", "cutoff")).alias("cutoff"))


def quality_rules(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by of every row.

    ``labels`` (doc_id, quality, toxic) name clean (quality 1, not toxic) and bad (quality 0) holdouts; an id labelled
    twice counts as its worst. With probability 1 - ``delta`` no stratum's rules together reject more
    than ``risk`` of its clean documents. A stratum with too few labels has no rules beyond the base; null is a stratum
    of its own. Null and empty texts have no words and fail the base. Repeated rows are judged each;
    null ids are never labelled; other columns are not read; an empty table gives an empty result.
    """
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    rows = durable(with_measures(measured(base, "text", ["doc_id", "stratum"]).withColumn("base_failed", base_failed())), "measures")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    known = known.filter("q = 0 or (q = 1 and x = 0)").select("doc_id", (F.col("q") == 1).alias("clean"))
    holdout = rows.filter("not base_failed").join(known, "doc_id")
    tests = durable(tests_of(holdout, "stratum", risk), "tests")
    cutoffs = durable(choose_cutoffs(tests, delta), "cutoffs")
    wide = cutoffs.groupBy(F.col("stratum").alias("__s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in GRID])
    judged = rows.join(wide, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    broken = F.concat_ws(",", *[F.when(F.col(r) >= F.col(f"__{r}"), F.lit(r)) for r in GRID])
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (broken == "")).alias("kept"),
        broken.alias("rejected_by"),
    )
