"""Benchmark decontamination: which words of a document lie in passages of benchmark items.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit; a document is contaminated if the hit words are at least a `share`-th of its words.

Method. Winnowing, in DataFrame operations only: of every `window - k + 1` consecutive `k`-word hashes the least is kept.
What a passage of `window` words keeps depends on that passage alone, so each window that a document shares with an item
gives both a fingerprint in common. Joined fingerprints name the documents to look at; there hits are extended to whole
windows, which are joined by 128-bit hashes of their words, and the union of the occurrences is measured. Items shorter
than a window are looked up by the hashes of all runs of their length.

Defined results: a null or wordless text has no words and no hits; items without an id or without words take no part;
repeated items count once; repeated documents each get a result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged, with_row_key

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["length", "h1", "h2"]


def _words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")


def _runs(n: Column, length: int, make) -> Column:
    """make(i) for the first word i, from 1, of every run of `length` of n things."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), n - (length - 1)), make)).otherwise(F.array())


def _fingerprints(rows: DataFrame, window: int, k: int, short: list[int], *keep: str) -> DataFrame:
    """keep, n_words and marks, the distinct fingerprints; rows: keep and words."""
    words = F.col("words")

    def whole(x):
        return F.array_distinct(_runs(F.size(words), x, lambda i: F.xxhash64(F.lit(x), F.slice(words, i, x))))

    grams = rows.select(*keep, F.size(words).alias("n_words"), _runs(F.size(words), k, lambda i: F.xxhash64(F.slice(words, i, k))).alias("grams"), *[whole(x).alias(f"short_{x}") for x in short])
    w = window - k + 1
    least = _runs(F.size("grams"), w, lambda i: F.array_min(F.slice("grams", i, w)))
    return grams.select(*keep, "n_words", F.concat(F.array_distinct(least), *[F.col(f"short_{x}") for x in short]).alias("marks"))


def _windows(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """keep, n_words, length, pos (from 0), h1, h2 of every run of words of the given lengths."""
    words = F.col("words")

    def window(x):
        return _runs(F.size(words), x, lambda i: F.struct(F.lit(x).alias("length"), (i - 1).alias("pos"), F.xxhash64(F.slice(words, i, x)).alias("h1"), F.xxhash64(F.lit(1), F.slice(words, i, x)).alias("h2")))

    runs = rows.select(*keep, F.size(words).alias("n_words"), F.concat(*map(window, lengths)).alias("runs"))
    # not explode: a filter that Catalyst infers for it would make the runs a second time, splitting the text for each
    return runs.select(*keep, "n_words", F.explode_outer("runs").alias("run")).where("run IS NOT NULL").select(*keep, "n_words", "run.*")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, told: Callable[[Column], dict[str, Column]] = lambda items: {"items": items}) -> DataFrame:
    """doc_id, row_key, n_words, n_hit and what is told of the items, which are ids sorted as strings (as such, unless `told` makes
    something smaller of them), for every row of docs (doc_id, text); benchmark: item_id, text.

    A window that many items share is one row, and items that documents have in common are put together once: a line of 10,000
    items in 10,000 documents gives neither 10^8 rows nor, with a small `told`, 10^8 strings."""
    items = staged(benchmark.where("item_id IS NOT NULL").select("item_id", _words("text").alias("words")), "items")
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {window - 1}").distinct().collect())
    lengths = [*short, window]
    # an item of at least a window's words is not looked up by its short runs, nor a short one by runs of its own
    whole = (F.col("length") == window) | (F.col("length") == F.col("n_words"))
    windows = _windows(items, lengths, "item_id").where(whole).select("item_id", *KEY).distinct()
    # windows of the same items share one number of their set, so a document takes a number for a window, not its items
    sets = windows.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("set", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b")))
    sets = staged(sets, "item_windows")
    known = sets.select(*KEY, "set")
    long_marks = _fingerprints(items.where(F.size("words") >= window), window, k, [], "item_id")
    marks = long_marks.select(F.explode_outer("marks").alias("mark")).where("mark IS NOT NULL")
    for x in short:
        marks = marks.unionAll(items.where(F.size("words") == x).select(F.xxhash64(F.lit(x), F.col("words")).alias("mark")))
    marks = staged(marks.distinct(), "item_marks")

    keyed = with_row_key(docs)
    rows = keyed.select("doc_id", "row_key", _words("text").alias("words"))
    marked = staged(_fingerprints(rows, window, k, short, "doc_id", "row_key"), "marks")
    met = marked.select("doc_id", "row_key", F.explode("marks").alias("mark")).join(marks, "mark", "left_semi")
    met = staged(met.select(F.col("doc_id").alias("met_id"), F.col("row_key").alias("met_key")).distinct(), "met")
    same = F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("row_key") == F.col("met_key"))
    look = keyed.join(met, same, "left_semi").select("doc_id", "row_key", _words("text").alias("words"))
    found = _windows(look, lengths, "doc_id", "row_key").join(known, KEY)
    hits = found.groupBy(F.col("doc_id").alias("met_id"), F.col("row_key").alias("met_key")).agg(F.collect_set(F.struct("pos", "length")).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))

    def grow(acc, span):
        end = span["pos"] + span["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], span["pos"]))).alias("n"))

    union = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grow)["n"]
    hits = staged(hits.select("met_id", "met_key", union.cast("long").alias("n_hit"), "sets"), "hits")
    # what a combination of sets tells is made once, however many documents have it
    each = hits.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets.select("set", "items").distinct(), "set")
    each = each.select("sets", F.explode("items").alias("item_id")).distinct().groupBy("sets").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    combined = each.select(F.col("sets").alias("of_sets"), *[c.alias(n) for n, c in told(F.col("items")).items()])
    hits = hits.join(combined, F.col("sets") == F.col("of_sets")).drop("sets", "of_sets")
    every = marked.select("doc_id", "row_key", F.col("n_words").cast("long").alias("n_words")).join(hits, same, "left")
    none = told(F.array().cast("array<string>"))
    return every.select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), *[F.coalesce(n, c).alias(n) for n, c in none.items()])


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """hits with the boolean `contaminated`."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
