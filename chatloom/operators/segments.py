"""Cutting conversations into segments within budgets, and what is planned over them.

A segment's core takes rows in time order while it has fewer than `core_rows` rows and its sizes stay within
`core_size`; the first row is always taken, so every row is core exactly once. Overlap rows before the core, within
budgets of their own, give context.

The cut is a fold in the order of rows, which no window frame expresses, and a conversation may hold a third of all rows.
So rows are numbered by sorted ranges, not in one window, and the fold runs in blocks of `BLOCK` rows: where a block's
first segment begins is one of `core_rows` places, so each block alone tells, for each of them, where the next block's
begins and how many segments it starts. Going from block to block then reads one short row a block, and every block is
cut by itself. Conversations of one block, which most are, are cut right away. Only (key, place, size) is moved about;
what goes with the rows is joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import relevance
from chatloom.sources.staging import staged

BLOCK = 4096

TASK = {"core_rows": 48, "core_size": 4000, "overlap_rows": 6, "overlap_size": 1000}
PEOPLE = {"core_rows": 320, "core_size": 24_000, "overlap_rows": 16, "overlap_size": 3000}
SELF = {"core_rows": 56, "core_size": 6000, "overlap_rows": 8, "overlap_size": 1000}
HISTORY_DAYS = 61


def placed(rows: DataFrame, key: str, order: list) -> DataFrame:
    """rows with their place, from 0, in the order of their key. Ranges of (key, order) are sorted and counted apart; the
    counts of a key's earlier ranges are added, so a long key is spread over tasks."""
    ranges = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    ranges = staged(ranges.withColumn("range_part", F.spark_partition_id()).withColumn("range_at", F.monotonically_increasing_id()), "ranges")
    heads = ranges.groupBy(F.col(key).alias("head_key"), F.col("range_part").alias("head_part")).agg(F.min("range_at").alias("head"), F.count("*").alias("n"))
    before = Window.partitionBy("head_key").orderBy("head_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("head_key", "head_part", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = ranges.join(heads, F.col(key).eqNullSafe(F.col("head_key")) & (F.col("range_part") == F.col("head_part")))
    return out.withColumn("place", F.col("range_at") - F.col("head") + F.col("base")).drop("range_part", "range_at", "head_key", "head_part", "head", "base")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each (key, block), whose rows come together."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch}
        if held:
            columns = {c: np.concatenate([held[c], columns[c]]) for c in columns}
        key, block = columns["key"], columns["block"]
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for x, y in zip(bounds, bounds[1:], strict=False):
            yield {c: v[x:y] for c, v in columns.items()}
        held = {c: v[bounds[-1] :] for c, v in columns.items()}  # the last may go on
    if held:
        yield held


def _ends(sizes: np.ndarray, core_rows: int, core_size: int) -> np.ndarray:
    """Where a segment that begins at each row ends."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[:-1] + core_size, "right") - 1
    return np.maximum(at + 1, np.minimum(at + core_rows, fits))


def _entries(narrow: DataFrame, core_rows: int, core_size: int, block: int) -> DataFrame:
    """key, block, entry, base for the blocks of keys of several: the first place in the block where a segment begins, and the
    segments before it."""
    long = narrow.where(F.col("place") == block).select("key")
    rows = narrow.join(long, "key", "left_semi").withColumn("block", F.floor(F.col("place") / block)).withColumn("own", F.lit(True))
    ahead = rows.where((F.col("block") > 0) & (F.col("place") % block < core_rows)).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            own = int(g["own"].sum())
            ends = _ends(g["size"], core_rows, core_size).tolist()
            out, count = [0] * own, [0] * own
            for i in range(own - 1, -1, -1):
                out[i], count[i] = (ends[i] - own, 1) if ends[i] >= own else (out[ends[i]], 1 + count[ends[i]])
            yield pd.DataFrame({"key": g["key"][:1], "block": g["block"][:1], "out": [out[:core_rows]], "count": [count[:core_rows]], "rows": [own]})

    dealt = rows.unionByName(ahead).repartition("key", "block").sortWithinPartitions("key", "block", "place")
    told = staged(dealt.select("key", "block", "size", "own").mapInPandas(summary, "key string, block long, out array<int>, count array<int>, rows int"), "blocks")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, entry, base = None, 0, 0
        for batch in batches:
            done = []
            for key, number, out, count, n in zip(*(batch[c] for c in ("key", "block", "out", "count", "rows")), strict=True):
                if key != at:
                    at, entry, base = key, 0, 0
                done.append((key, number, entry, base))
                if entry < n:
                    entry, base = out[entry], base + count[entry]
            yield pd.DataFrame(done, columns=["key", "block", "entry", "base"])

    return told.repartition("key").sortWithinPartitions("key", "block").mapInPandas(walk, "key string, block long, entry long, base long")


def segments(rows: DataFrame, key: str, size: str, core_rows: int, core_size: int, block: int = BLOCK, **_) -> DataFrame:
    """rows (with a place) and their segment, from 1. Sizes are not negative."""
    if block < core_rows:
        raise ValueError("a block holds a segment at least")
    narrow = rows.select(F.col(key).cast("string").alias("key"), "place", F.col(size).cast("long").alias("size"))
    entries = staged(_entries(narrow, core_rows, core_size, block), "entries")
    known = narrow.withColumn("block", F.floor(F.col("place") / block)).join(entries, ["key", "block"], "left")

    def whole(parts: list) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("key", "place", "segment"), zip(*parts, strict=True), strict=True)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, n = [], 0
        for g in _groups(batches):
            ends = _ends(g["size"], core_rows, core_size).tolist()
            at, starts = int(g["entry"][0]), np.zeros(len(ends), np.int64)
            while at < len(ends):
                starts[at] = 1
                at = ends[at]
            done.append((g["key"], g["place"], g["base"][0] + np.cumsum(starts)))
            n += len(ends)
            if n >= BLOCK:
                yield whole(done)
                done, n = [], 0
        if done:
            yield whole(done)

    dealt = known.fillna(0, ["entry", "base"]).repartition("key", "block").sortWithinPartitions("key", "block", "place")
    found = dealt.select("key", "block", "place", "size", "entry", "base").mapInPandas(cut, "key string, place long, segment long")
    found = found.withColumnRenamed("key", "segment_key").withColumnRenamed("place", "segment_place")
    return rows.join(found, (F.col(key).cast("string") == F.col("segment_key")) & (F.col("place") == F.col("segment_place"))).drop("segment_key", "segment_place")


def in_blocks(rows: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """rows (with a place) with their block and whether they are its own. The last `before` rows of a block also stand in the next
    one, the first `after` in the one before, so a frame of so many rows needs no more than its block, however long the key."""
    if max(before, after) > block:
        raise ValueError("a frame reaches over one block at most")
    at, nth = F.floor(F.col("place") / block), F.col("place") % block

    def there(b: Column, own: bool) -> Column:
        return F.struct(b.cast("long").alias("block"), F.lit(own).alias("own"))

    copies = [there(at, True)]
    if before:
        copies.append(F.when(nth >= block - before, there(at + 1, False)))
    if after:
        copies.append(F.when((nth < after) & (at > 0), there(at - 1, False)))
    dealt = rows.withColumn("copy", F.explode(F.array_compact(F.array(*copies))))
    return dealt.withColumns({"block": F.col("copy.block"), "own": F.col("copy.own")}).drop("copy")


def overlaps(rows: DataFrame, key: str, size: str, overlap_rows: int, overlap_size: int, block: int = BLOCK, **_) -> DataFrame:
    """For every segment its first place and how many rows before it are its overlap: the nearest ones, of which the first is
    always taken. A frame of overlap_rows rows is all that is looked at, and blocks hand it on."""
    dealt = in_blocks(rows.select(key, "segment", "place", F.col(size).cast("long").alias("size")), before=overlap_rows, block=block)
    before = Window.partitionBy(key, "block").orderBy("place").rowsBetween(-overlap_rows, -1)
    sizes = F.reverse(F.collect_list("size").over(before))  # the nearest first

    def take(state, s):
        go = state["go"] & ((state["n"] == 0) | (state["used"] + s <= overlap_size))
        return F.struct(go.alias("go"), (state["n"] + go.cast("int")).alias("n"), (state["used"] + F.when(go, s).otherwise(0)).alias("used"))

    begin = F.struct(F.lit(True).alias("go"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"))
    n = F.aggregate(sizes, begin, take)["n"] if overlap_rows else F.lit(0)
    heads = dealt.withColumn("overlap", n.cast("long")).where("own")
    first = heads.groupBy(key, "segment").agg(F.min("place").alias("first_place"), F.min_by("overlap", "place").alias("overlap"))
    return first.select(key, "segment", "first_place", "overlap")


def plan(rows: DataFrame, key: str, at: str, as_of: str) -> DataFrame:
    """key, segment, segments, rows, historical, priority: recent segments have at least 1, and the more relevant more."""
    old = F.max(at) < (F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(HISTORY_DAYS)))
    each = rows.groupBy(key, "segment").agg(F.count("*").alias("rows"), F.coalesce(old, F.lit(False)).alias("historical"), F.max(relevance(F.col(at), as_of)).alias("best"))
    each = each.withColumn("segments", F.count("*").over(Window.partitionBy(key)))
    return each.select(key, "segment", "segments", "rows", "historical", F.round(F.col("best") + F.when(F.col("historical"), 0.0).otherwise(1.0), 2).alias("priority"))


def interleaved(plan_rows: DataFrame, key: str) -> DataFrame:
    """The plan with its turn within each segment number, from 1: the k-th segment of every conversation goes before any k+1-st,
    and of those the long conversations' first. Most conversations have a first segment, so turns are counted by sorted ranges."""
    total = plan_rows.withColumn("total", F.sum("rows").over(Window.partitionBy(key)))
    turns = placed(total, "segment", [F.col("total").desc(), F.col("segments").desc(), F.col(key)])
    return turns.withColumn("turn", F.col("place") + 1).drop("place")


def calendar_chunks(rows: DataFrame, at: str, most: int = 120, *by: str) -> DataFrame:
    """rows with their chunk: a new one at every quarter and after `most` rows."""
    quarter = F.date_trunc("quarter", at).cast("date")
    nth = F.row_number().over(Window.partitionBy(*by, quarter).orderBy(at, "id")) - 1
    return rows.withColumn("quarter", F.date_format(quarter, "yyyy-MM")).withColumn("chunk", F.floor(nth / most).cast("long"))


def ranges(rows: DataFrame, number: str, by: str) -> DataFrame:
    """Runs of consecutive numbers as text: 1-3, 7. Numbers are placed by sorted ranges, so a key may have any number of them; what
    comes together is its runs."""
    each = placed(rows.select(by, number).where(F.col(number).isNotNull()).distinct(), by, [F.col(number)])
    runs = each.groupBy(by, (F.col(number) - F.col("place")).alias("island")).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
    return runs.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", one.alias("text")))), lambda x: x["text"]), ", ").alias("ranges"))
