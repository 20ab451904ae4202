"""Substring dedup: words of passages that an earlier document has too are removed.

A window is `window` consecutive words of one document. The words of a window whose word sequence also starts in a
document with a smaller doc_id are removed; the first document that has it keeps it.

Method. Every window is known by its anchor, the least hash among the `gram`-word sequences in it, which depends on
nothing but the window's words; neighbouring windows mostly share one, so a document has few. Each partition counts its
documents' anchors in a count-min sketch with two rows of saturating counters, and the partitions' sketches are added up
block by block: an anchor's upper bits name its block, and both its counters are in that block, so the sketch is a table
with a row a block whose number of blocks follows the corpus. An anchor's estimate is never below the number of documents
that hold any one of its windows, so the second pass, a semi-join of runs of windows with the blocks, takes only windows
whose anchor is estimated repeated and loses none. It groups runs of windows that share an anchor by the 128-bit digest of
their words, and the single windows only of runs whose anchor has different runs. There is one pass for the sketch and one
for the runs at any size; Spark broadcasts the blocks while they are few and joins by a shuffle beyond.

Defined results: a null text has no words; texts shorter than a window lose nothing; rows without a doc_id have no
place in the order, so they neither lose words nor make others lose any; rows that repeat a doc_id never remove each
other's words; equal rows are judged once for all and each get the result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, in_arrow, mixed, sliding_min, spaced, staged, with_row_key, word_hashes, words

#: Counters of a block in either row, and for each anchor that a block is made for.
CELLS_LOG2, ROOM = 15, 4


def _anchors(data, offsets, window: int, gram: int):
    """Words, the starts of whole windows, their rows and their anchors' hashes."""
    starts, ends, rows = words(data, offsets)
    n = len(starts) - window + 1
    if n <= 0:
        return starts, ends, rows, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(gram_hashes(word_hashes(data, starts, ends), gram), window - gram + 1)
    at = np.flatnonzero(rows[:n] == rows[window - 1 :])
    return starts, ends, rows, at, least[at]


def _runs(data, offsets, window: int, gram: int):
    """Words (start, end, row), and of every run of windows with one anchor: its first window, length, row and anchor."""
    starts, ends, rows, at, least = _anchors(data, offsets, window, gram)
    row = rows[at]
    change = np.ones(len(at), bool)
    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(change)
    return starts, ends, rows, at[heads], np.diff(np.append(heads, len(at))), row[heads], least[heads]


def cells_of(anchors: np.ndarray, blocks_log2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each anchor and its counters there in the first and in the second row, numbered on."""
    block = (anchors >> np.uint64(64 - blocks_log2)).astype(np.int64) if blocks_log2 else np.zeros(len(anchors), np.int64)
    both = mixed(anchors + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << CELLS_LOG2) - 1)
    return block, (both & low).astype(np.int64), (both >> np.uint64(64 - CELLS_LOG2)).astype(np.int64) + (1 << CELLS_LOG2)


def blocks_for(text_bytes: int, window: int, gram: int) -> int:
    """Upper bits of an anchor that name its block, for about as many anchors as texts of that size have."""
    anchors = int(text_bytes / 6 * 2 / (window - gram + 2))
    return max(0, (anchors * ROOM >> CELLS_LOG2).bit_length())


def sketch(docs: DataFrame, window: int, gram: int, blocks_log2: int) -> DataFrame:
    """block, bits (an array of 64-bit words): one bit a counter, set if it counts two or more."""
    room = CELLS_LOG2 + 1

    def partition(batches):
        held, size = [], 0

        def summed():
            cells, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(cells)
            cells = cells[order]
            heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            return cells[heads], np.minimum(np.add.reduceat(counts[order], heads), 2).astype(np.int8)

        for batch in batches:
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for first, end, data, offsets in chunks(batch.column("text")):
                *_, row, anchors = _runs(data, offsets, window, gram)
                good = known[first:end][row]
                row, anchors = row[good], anchors[good]
                order = np.lexsort((anchors, row))  # a document counts an anchor once
                row, anchors = row[order], anchors[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
                block, one, two = cells_of(anchors[once], blocks_log2)
                for cell in (one, two):
                    held.append(((block << room) | cell, np.ones(len(block), np.int8)))
                    size += len(block)
            if size > 1 << 23:
                held = [summed()]
                size = len(held[0][0])
        if size:
            cells, counts = summed()
            block = cells >> room
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            own = ((cells & ((1 << room) - 1)) << 1 | (counts > 1)).astype("<u4")
            for part in np.array_split(np.arange(len(heads)), len(heads) // 4096 + 1):
                until = np.append(heads, len(cells))[part + 1]
                yield pa.RecordBatch.from_pydict({"block": pa.array(block[heads[part]]), "cells": pa.array([own[a:b].tobytes() for a, b in zip(heads[part].tolist(), until.tolist(), strict=True)], pa.binary())})

    def merge(key, table):
        counts = np.zeros(1 << room, np.uint8)
        for raw in table.column("cells").to_pylist():
            cells = np.frombuffer(raw, "<u4")
            at = cells >> 1
            counts[at] = np.minimum(counts[at] + 1 + (cells & 1), 2)
        bits = np.packbits(counts >= 2, bitorder="little").view("<i8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.list_(pa.int64()))})

    parts = docs.select("doc_id", "text").mapInArrow(partition, "block long, cells binary")
    return parts.groupBy("block").applyInArrow(merge, "block long, bits array<long>")


def _digests(text: bytes, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits, as two integers, of the words from each first to before each end."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(place[first].tolist(), (place[end] - 1).tolist(), strict=True)]), "<i8").reshape(-1, 2)


def segments(docs: DataFrame, window: int, gram: int, blocks_log2: int) -> DataFrame:
    """anchor, block, one, two (its counters), h1, h2, doc_id, row_key, start, n: runs of n windows of one anchor with the digest of their words."""

    def batch_segments(batch):
        ids, keys = batch.column("doc_id"), batch.column("row_key").to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in chunks(batch.column("text")):
            starts, ends, rows, begin, size, row, anchors = _runs(data, offsets, window, gram)
            good = known[first:end][row]
            if not good.any():
                continue
            begin, size, row, anchors = begin[good], size[good], row[good], anchors[good]
            block, one, two = cells_of(anchors, blocks_log2)
            found = _digests(*spaced(data, starts, ends), begin, begin + size - 1 + window)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(anchors.view(np.int64)),
                    "block": pa.array(block),
                    "one": pa.array(one.astype(np.int32)),
                    "two": pa.array(two.astype(np.int32)),
                    "h1": pa.array(found[:, 0]),
                    "h2": pa.array(found[:, 1]),
                    "doc_id": pa.array(ids[first:end][row], pa.int64()),
                    "row_key": pa.array(keys[first:end][row], pa.int64()),
                    "start": pa.array((begin - np.searchsorted(rows, row)).astype(np.int32)),
                    "n": pa.array(size.astype(np.int32)),
                }
            )

    return in_arrow(docs, batch_segments, "anchor long, block long, one int, two int, h1 long, h2 long, doc_id long, row_key long, start int, n int")


def estimated_repeated(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The runs whose anchor has two counters of two or more."""

    def twice(cell):
        return F.getbit(F.get(F.col("bits"), F.shiftright(cell, 6)), F.col(cell).bitwiseAND(63)) == 1

    named = blocks.withColumnRenamed("block", "of")
    return runs.join(named, (F.col("block") == F.col("of")) & twice("one") & twice("two"), "left_semi").drop("block", "one", "two")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, row_key, start of every window in the runs that `open` lists."""

    def batch_windows(batch):
        ids, keys, runs = (batch.column(x) for x in ("doc_id", "row_key", "open"))
        for first, end, data, offsets in chunks(batch.column("text")):
            starts, ends, rows = words(data, offsets)
            text, place = spaced(data, starts, ends)
            heads = np.searchsorted(rows, np.arange(end - first))
            at = [np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in runs[i].as_py()]) for i in range(first, end)]
            row = np.repeat(np.arange(end - first), [len(x) for x in at])
            begin = np.concatenate(at)
            found = _digests(text, place, begin + heads[row], begin + heads[row] + window)
            pick = pa.array(row + first)
            yield pa.RecordBatch.from_pydict({"h1": pa.array(found[:, 0]), "h2": pa.array(found[:, 1]), "doc_id": ids.take(pick), "row_key": keys.take(pick), "start": pa.array(begin.astype(np.int32))})

    return in_arrow(docs, batch_windows, "h1 long, h2 long, doc_id long, row_key long, start int")


def _without(docs: DataFrame, window: int) -> DataFrame:
    """docs with `hits`, the runs of their removed windows, to doc_id, text, n_words, n_removed."""

    def cut(batch):
        ids, hits = batch.column("doc_id"), batch.column("hits")
        has = hits.is_valid().to_numpy(zero_copy_only=False)
        for first, end, data, offsets in chunks(batch.column("text")):
            starts, ends, rows = words(data, offsets)
            counts = np.bincount(rows, minlength=end - first)
            heads = np.concatenate([[0], np.cumsum(counts)])
            cover = np.zeros(len(starts) + 1, np.int32)
            for i in np.flatnonzero(has[first:end]):
                runs = hits[first + i].values
                at, n = (np.asarray(runs.field(x)) for x in ("start", "n"))
                np.add.at(cover, at + heads[i], 1)
                np.add.at(cover, at + heads[i] + n - 1 + window, -1)
            stay = np.cumsum(cover[:-1]) == 0
            left = np.bincount(rows[stay], minlength=end - first)
            cuts, raw = np.concatenate([[0], np.cumsum(left)]), data.tobytes()
            kept = [raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids.slice(first, end - first), "text": pa.array([b" ".join(kept[cuts[i] : cuts[i + 1]]) for i in range(end - first)], pa.binary()).cast(pa.string()), "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array((counts - left).astype(np.int64))}
            )

    return in_arrow(docs.select("doc_id", "text", "hits"), cut, "doc_id long, text string, n_words long, n_removed long")


def remove_repeated_passages(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, text (kept words with one space between), n_words, n_removed for every row of docs (doc_id, text)."""
    docs = with_row_key(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks_log2 = blocks_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, window, gram)
    blocks = staged(sketch(docs, window, gram, blocks_log2), "sketch")
    every = staged(estimated_repeated(segments(docs, window, gram, blocks_log2), blocks), "segments")
    # The same run in an earlier document: all its windows are there. A window's first document is the first holder of
    # the run it lies in, so only first holders are left, and of them only those whose anchor has other runs as well.
    runs = staged(every.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "runs")
    several = staged(runs.groupBy("anchor").count().where(F.col("count") > 1).select("anchor", F.lit(True).alias("several")), "several")
    runs = runs.join(several, "anchor", "left").select("h1", "h2", "first", "last", F.coalesce("several", F.lit(False)).alias("several"))
    runs = staged(runs.where("several or first < last").drop("last"), "repeated")
    judged = every.join(runs, ["h1", "h2"]).where("several or doc_id > first")
    judged = staged(judged.select("doc_id", "row_key", "start", "n", (F.col("doc_id") > F.col("first")).alias("gone")), "judged")
    # sets: rows that repeat an id and its text have one list of runs between them
    opened = judged.where("not gone").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("open"))
    windows = staged(_windows(docs.join(opened, ["doc_id", "row_key"]), window), "windows")
    shared = staged(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "shared")
    single = windows.join(shared, ["h1", "h2"]).where("doc_id > first").select("doc_id", "row_key", "start", F.lit(1).alias("n"))
    hits = judged.where("gone").drop("gone").unionAll(single).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("hits"))
    return _without(docs.join(hits, ["doc_id", "row_key"], "left"), window)
