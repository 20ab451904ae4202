"""Connected components of keys, for folds that must not be parted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.sources.staging import staged


def _rooted(to: DataFrame) -> DataFrame:
    """node, block of (node, block) that lead to lower nodes: the block that is its own, in a logarithmic number of jumps."""
    while True:
        on = to.select(F.col("node").alias("block"), F.col("block").alias("next"))
        jumped = staged(to.join(on, "block").select("node", F.col("next").alias("block"), (F.col("next") < F.col("block")).alias("moved")), "labels")
        to = jumped.select("node", "block")
        if jumped.where("moved").isEmpty():
            return to


def connected(edges: DataFrame) -> DataFrame:
    """node, block: the least node of its component, for every node of the edges (a, b). Every node falls to its least neighbour and
    so to the root of a tree; what is left are the edges between roots. In two rounds each root that has edges meets another, so
    roots are halved: a chain takes a logarithmic number of rounds, and settled components are in none of the later ones."""

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left, falls = staged(edges.select(*ordered("a", "b")).distinct(), "edges"), []
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("block"))
        falls.append(_rooted(staged(least, "labels")))
        a, b = [falls[-1].select(F.col("node").alias(c), F.col("block").alias(f"root_{c}")) for c in "ab"]
        between = left.where("a <> b").join(a, "a").join(b, "b").where("root_a <> root_b")
        left = staged(between.select(*ordered("root_a", "root_b")).distinct(), "edges")
        if left.isEmpty():
            break
    labels = falls.pop()
    for fall in reversed(falls):
        later = labels.select(F.col("node").alias("block"), F.col("block").alias("lower"))
        labels = staged(fall.join(later, "block", "left").select("node", F.coalesce("lower", "block").alias("block")), "labels")
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels (node, block) with more edges (a, b), and moved: was, block for every old block or new node that they reach. Known
    nodes stand for their block, so only what the new edges reach is gone through; the result is that of all edges at once."""
    new = staged(edges.select("a", "b").distinct(), "edges")
    nodes = new.select(F.col("a").alias("node")).union(new.select("b")).distinct()
    known = staged(nodes.join(labels, "node", "left").select("node", F.coalesce("block", "node").alias("was"), F.col("block").isNull().alias("fresh")), "known")
    a, b = known.select(F.col("node").alias("a"), F.col("was").alias("was_a")), known.select(F.col("node").alias("b"), F.col("was").alias("was_b"))
    between = new.join(a, "a").join(b, "b").select(F.col("was_a").alias("a"), F.col("was_b").alias("b"))
    moved = staged(connected(between).select(F.col("node").alias("was"), "block"), "moved")
    to = moved.where("was <> block").withColumnRenamed("block", "to")
    old = labels.join(to, F.col("block") == F.col("was"), "left").select("node", F.coalesce("to", "block").alias("block"))
    more = known.where("fresh").join(moved, "was").select("node", "block")
    return staged(old.unionByName(more), "labels"), moved
