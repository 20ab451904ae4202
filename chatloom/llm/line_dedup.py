"""Line dedup: lines whose key is found in many documents are dropped everywhere.

A line's key is the line without the white space (space, tab to carriage return) at both ends and with A-Z lower-cased.
Keys of at least `min_chars` code points found in at least `min_documents` documents lose all their lines.

Method. Documents are taken in batches. A run is a table of (128-bit line hash, documents that hold it), bucketed and
sorted by the hash, so runs meet each other and new batches by merging. Each batch's hashes merge-anti-join the hashes
that the runs already know to be common, and what is left is added as a run of level 0; as soon as a level holds
`fanout` runs they are compacted into one run of the next level. At the end the runs' counts are added up. All of it is
DataFrame operations.

Defined results: a null or empty text is one empty line; a key of no code points is never common; rows that repeat a
doc_id and its text count as one document and each get a result; a row without a doc_id counts as a document by its
text; a document that loses every line keeps an empty text; columns other than doc_id and text are ignored here and
kept by `drop_common_lines(..., keep=...)`.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, new_path, staged, with_row_key

WHITE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_hashes(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """h1, h2, doc_id, row_key, pos, batch of every line whose key is long enough."""
    lines = docs.select("doc_id", "row_key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row_key", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.select("doc_id", "row_key", "pos", ascii_lower(F.col("key")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "row_key", "pos", F.pmod("row_key", F.lit(batches)).cast("int").alias("batch"))


@contextmanager
def in_bucket_order(spark):
    """Plans that are made inside know that a bucket of one file is sorted, so runs are merged without sorting them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Runs:
    """The levelled runs."""

    def __init__(self, spark, min_documents: int, fanout: int):
        self.spark, self.least, self.fanout = spark, min_documents, fanout
        self.levels: list[list[DataFrame]] = []

    def _written(self, counts: DataFrame) -> DataFrame:
        with in_bucket_order(self.spark):
            return bucketed(counts, new_path(self.spark, "runs"), HASH)

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, n of documents that no earlier batch held."""
        for run in (r for level in self.levels for r in level):
            known = run.where(F.col("n") >= self.least).select(*HASH)
            batch = batch.join(known.hint("merge"), HASH, "left_anti")
        self._place(self._written(batch), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self._summed(self.levels[level]), []
            self._place(self._written(merged), level + 1)

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        """The runs merged, bucket by bucket in the order of their hashes."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m").hint("merge"), HASH, "full")
            return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(merge, runs)

    def common(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return self._summed(runs).where(F.col("n") >= self.least).select(*HASH)


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, batches: int = 6, fanout: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the `keep` columns, text (the lines that stay), n_lines and n_dropped for every row of docs."""
    keyed = with_row_key(docs, *keep)
    lines = staged(line_hashes(keyed, min_chars, batches), "lines")
    runs = Runs(docs.sparkSession, min_documents, fanout)
    for i in range(batches):
        once = lines.where(F.col("batch") == i).groupBy(*HASH, "doc_id", "row_key").agg(F.lit(1).alias("one"))
        runs.add(once.groupBy(*HASH).agg(F.count("*").alias("n")))
    with in_bucket_order(docs.sparkSession):
        common = staged(runs.common(), "common")
    dropped = lines.join(common, HASH).select(F.col("doc_id").alias("drop_id"), F.col("row_key").alias("drop_key"), "pos").groupBy("drop_id", "drop_key").agg(F.collect_set("pos").alias("dropped"))
    both = keyed.join(dropped, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key")), "left")
    both = both.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"), "dropped")
    cut = both.select("doc_id", *keep, "text", "dropped", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return cut.select(
        "doc_id",
        *keep,
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )
