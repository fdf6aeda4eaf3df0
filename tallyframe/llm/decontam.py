"""Benchmark passages in training text through a stored positional inverted index.

Method: training text is posted as (term, document, position) for the terms by which test passages are looked
up, the rarest of each passage. Their posting lists are shifted by the term's place in the passage and
intersected, rarest first; what survives is compared word by word for exact phrases, or reported with
its distance for proximity. Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyframe.llm.columns import row_key
from tallyframe.plans.durable import durable

#: Words of a window; items with fewer are one window of all their words.
WINDOW = 10
#: Posting lists intersected per window before the words are compared.
LOOKUPS = 2
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased: runs of other characters than ASCII signs and controls; null has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Only the first and the last part can be empty.
    return F.array_remove(F.split(low, _SEPARATORS), "")


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window bigint, words, items): the distinct windows, each with the ids of the items that hold it."""
    tokens = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = tokens.select("item", "w", F.explode(at).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("words"))
    # A null id cannot be listed, but its windows are hit like others.
    held = cut.groupBy("words").agg(F.collect_set("item").alias("items"))
    return held.withColumn("window", F.monotonically_increasing_id())


def positions(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, rk, n_words, position from 0, term) for every word of every whole text."""
    rk, _ = row_key(doc_id, text)
    return df.select(F.col(doc_id).alias("doc_id"), rk.alias("rk"), F.posexplode(words_of(F.col(text))).alias("position", "term"))


def frequencies(df: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, n) over all text, of the given terms; 0 where there is none. Counts are summed before the shuffle.

    Written and read back: joined by its size, it hands on no partitioning by term, in which the windows' commonest word would be one task.
    """
    seen = positions(df, text, doc_id).select("term").join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return durable(terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "frequencies")


def lookups(windows: DataFrame, frequency: DataFrame, count: int = LOOKUPS) -> DataFrame:
    """(window, term, place, turn): the ``count`` rarest terms of each window and their place in it.

    A window has at most WINDOW words, so ranking them is bounded.
    """
    words = windows.select("window", F.posexplode("words").alias("place", "term"))
    rank = W.partitionBy("window").orderBy("n", "term", "place")
    return words.join(frequency, "term").withColumn("turn", F.row_number().over(rank)).filter(F.col("turn") <= count).select("window", "term", "place", "turn")


def build_index(df: DataFrame, looked: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The stored postings (term, doc_id, rk, position) of the looked-up terms, written as a table."""
    return durable(positions(df, text, doc_id).join(looked.select("term").distinct(), "term"), "postings")


def starts(index: DataFrame, looked: DataFrame, slop: int = 0) -> DataFrame:
    """(window, doc_id, rk, start, distance): passage starts on which all looked-up terms agree to ``slop`` words.

    Each term's postings are shifted by its place; starts of the rarest term are kept where every other term
    has one near enough. Joins are by (window, document, start), so a very common passage is many keys.
    """
    shifted = looked.join(index, "term").select("window", "turn", "doc_id", "rk", (F.col("position") - F.col("place")).alias("start"))
    first = shifted.filter("turn = 1").drop("turn").withColumn("distance", F.lit(0))
    needed = looked.groupBy("window").agg(F.max("turn").alias("turns"))
    for turn in range(2, LOOKUPS + 1):
        other = shifted.filter(F.col("turn") == turn).select("window", F.col("doc_id").alias("d2"), F.col("rk").alias("r2"), F.col("start").alias("near"))
        if slop:
            reach = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
            other = other.withColumn("off", reach).withColumn("near", F.col("near") + F.col("off"))
            other = other.groupBy("window", "d2", "r2", "near").agg(F.min(F.abs("off")).alias("off"))
        else:
            other = other.distinct().withColumn("off", F.lit(0))
        other = other.withColumnRenamed("window", "w2")
        on = (F.col("window") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("r2")) & (F.col("start") == F.col("near"))
        joined = first.join(other, on, "left").join(needed, "window")
        first = joined.filter((F.col("turns") < turn) | F.col("w2").isNotNull()).select(
            "window", "doc_id", "rk", "start", F.greatest("distance", F.coalesce("off", F.lit(0))).alias("distance")
        )
    return first


def phrases(df: DataFrame, candidates: DataFrame, windows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rk, window, items, start, length) of the candidate starts whose words equal the window's."""
    rk, _ = row_key(doc_id, text)
    per_row = candidates.groupBy(F.col("doc_id").alias("d2"), F.col("rk").alias("r2"), "start").agg(F.collect_list("window").alias("w"))
    per_row = per_row.groupBy("d2", "r2").agg(F.collect_list(F.struct("start", "w")).alias("at"))
    rows = df.select(F.col(doc_id).alias("doc_id"), rk.alias("rk"), F.col(text).alias("__t"))
    on = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("r2"))
    rows = rows.join(per_row, on).select("doc_id", "rk", words_of(F.col("__t")).alias("t"), "at")
    found = rows.select("doc_id", "rk", F.explode(F.transform("at", lambda a: F.struct(a["start"].alias("start"), a["w"].alias("w"), F.when(a["start"] >= 0, F.slice(F.col("t"), F.greatest(a["start"], F.lit(0)) + 1, WINDOW)).alias("seen")))).alias("a"))
    found = found.select("doc_id", "rk", "a.start", "a.seen", F.explode("a.w").alias("window"))
    return found.join(windows, "window").filter(F.slice("seen", 1, F.size("words")) == F.col("words")).select(
        "doc_id", "rk", "window", "items", "start", F.size("words").alias("length")
    )


def proximity_matches(df: DataFrame, items: DataFrame, slop: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, items, start, distance): places where a window's rarest terms stand within ``slop`` words of their order."""
    windows = durable(windows_of(items), "windows")
    looked = durable(lookups(windows, frequencies(df, windows.select(F.explode("words").alias("term")).distinct(), text, doc_id)), "lookups")
    near = starts(build_index(df, looked, text, doc_id), looked, slop)
    return near.join(windows.select("window", "items"), "window").select("doc_id", "items", "start", "distance")


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and rk (content key) of every row.

    A word inside any occurrence of a window of a test item is hit. Null texts have no words; null ids and repeated
    rows are judged by what they hold; an empty test set or table hits nothing; other columns are
    not read. Nothing but the test windows' own terms is posted, and no list of a frequent term is gathered: hits
    of a row are counted as keys.
    """
    windows = durable(windows_of(items), "windows")
    terms = durable(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    looked = durable(lookups(windows, frequencies(df, terms, text, doc_id)), "lookups")
    candidates = durable(starts(build_index(df, looked, text, doc_id), looked), "starts")
    hits = durable(phrases(df, candidates, windows, text, doc_id), "phrases")
    covered = hits.select("doc_id", "rk", F.explode(F.expr("sequence(start, start + length - 1)")).alias("p")).distinct()
    n_hit = covered.groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hits.select("doc_id", "rk", F.explode_outer("items").alias("item")).groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("item")).alias("names"))
    both = n_hit.join(names.withColumnsRenamed({"doc_id": "d3", "rk": "r3"}), F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("rk") == F.col("r3"))).select(
        F.col("doc_id").alias("d2"), F.col("rk").alias("r2"), "n_hit", "names"
    )
    rk, _ = row_key(doc_id, text)
    rows = df.select(F.col(doc_id).alias("doc_id"), rk.alias("rk"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("r2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "names").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "rk",
    )
