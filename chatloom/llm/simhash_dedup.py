"""SimHash near-dedup: documents whose fingerprints differ in few bits form groups.

A fingerprint is taken over the text with A-Z lower-cased, cut into words at white space and into `shingle`-word
shingles, repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 values.

Method. Equal fingerprints are one. Of the 64 bits cut into blocks, two fingerprints that differ in at most `distance` bits
share at least blocks - distance whole blocks, so every choice of that many blocks gives a bucket key and each close pair
meets in some bucket, where its Hamming distance is verified. There are as many blocks as give keys of about as many bits as
the number of fingerprints has, so buckets stay small on average. A bucket of more than `bucket_limit` fingerprints is parted
by the same rule: the bits outside its key are cut into blocks in their turn, and choices of these make longer keys. A bucket
gives the edges of a spanning forest, never all its pairs. Components come from least-label propagation with pointer jumping
over staged tables.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; a row without a doc_id takes part, but a component's id is its least doc_id that
is there (null if none is); repeated rows each get a result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_arrow, lowered, spaced, staged, with_row_key, words

_LANES = np.uint64(0x0101010101010101)
_PART = 255  # the sums of so many bits fit a byte


def _majority(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; every count is one or more."""
    parts = -(-count // _PART)
    owner = np.repeat(np.arange(len(first)), parts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[owner] + step * _PART
    heads = np.cumsum(parts) - parts
    out = np.zeros(len(first), np.uint64)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, begin)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        over = (2 * bits > count[:, None]).astype(np.uint64)
        out |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits as a long) and the `keep` columns (longs) for every row of docs."""

    def marked(batch):
        ids = batch.column("doc_id")
        for first, end, data, offsets in chunks(batch.column("text")):
            data = lowered(data)
            starts, ends, rows = words(data, offsets)
            out = np.zeros(end - first, np.uint64)
            if len(starts):
                text, place = spaced(data, starts, ends)
                count = np.bincount(rows, minlength=end - first)
                heads = np.cumsum(count) - count
                n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
                has = np.flatnonzero(n)
                before = np.cumsum(n) - n
                at = np.arange(n.sum()) - np.repeat(before - heads, n)
                until = np.minimum(at + shingle, np.repeat(heads + count, n))
                digest = xxhash.xxh64_digest
                hashes = np.frombuffer(b"".join([digest(text[a:b], seed) for a, b in zip(place[at].tolist(), (place[until] - 1).tolist(), strict=True)]), ">u8").astype(np.uint64)
                out[has] = _majority(hashes, before[has], n[has])
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, end - first), "fp": pa.array(out.view(np.int64))} | {x: batch.column(x).slice(first, end - first) for x in keep})

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), marked, "doc_id long, fp long" + "".join(f", {x} long" for x in keep))


# Links --------------------------------------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


ALL = (1 << 64) - 1
#: A bucket whose key leaves so few bits has few enough fingerprints.
FEW_BITS = 14


def block_masks(blocks: int, distance: int, mask: int = 0) -> list[int]:
    """The mask and every choice of blocks - distance of the blocks that the other bits are cut into."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    each = [sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [mask + sum(x) for x in combinations(each, blocks - distance)]


def blocks_for(fingerprints: int, distance: int) -> int:
    """The least number of blocks whose keys have as many bits as that number of fingerprints, and at least distance + 2."""
    blocks = distance + 2
    while 64 * (blocks - distance) / blocks < fingerprints.bit_length() - 1 and blocks < 4 * distance:
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the close pairs in one bucket: each step takes what is near out of those not reached yet."""
    left, right = [], []
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), x, np.uint64))
                right.append(new)
                front.extend(new)
                rest = rest[~near]
    return left, right


def _bucket_edges(distance: int, small: int = 8):
    """For rows (mask, part, fp) in the order of their keys: the edges within buckets."""

    def edges(bucket, part, fp):
        change = np.empty(len(fp), bool)
        change[0], change[1:] = True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(change)
        size = np.diff(np.append(heads, len(fp)))
        of = np.repeat(np.arange(len(heads)), size)
        left, right = [], []
        little = np.repeat((size > 1) & (size <= small), size)
        for d in range(1, min(small, int(size.max(initial=1)))):
            i = np.flatnonzero(little[:-d] & (of[:-d] == of[d:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            left.append(fp[i])
            right.append(fp[i + d])
        for g in np.flatnonzero(size > small):
            a, b = _forest(fp[heads[g] : heads[g] + size[g]], distance)
            left += a
            right += b
        if left:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left).view(np.int64)), "b": pa.array(np.concatenate(right).view(np.int64))})

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(x).to_numpy() for x in ("mask", "part")] + [batch.column("fp").to_numpy().view(np.uint64)]
            if held:
                now = [np.concatenate([x[k] for x in held] + [now[k]]) for k in range(3)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield from edges(*(x[:cut] for x in now))
            held = [tuple(x[cut:] for x in now)]
        if held:
            yield from edges(*held[0])

    return run


def _keyed(keys: DataFrame) -> DataFrame:
    return keys.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")


def close_edges(fps: DataFrame, distance: int = 4, blocks: int | None = None, bucket_limit: int = 20000) -> DataFrame:
    """a, b: enough verified close pairs among the distinct fps (a column fp) to connect all that are connected."""
    spark = fps.sparkSession
    masks = block_masks(blocks or blocks_for(fps.count(), distance), distance)
    keys = _keyed(fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp"))
    edges = None
    while True:
        parted = [m for m in masks if 64 - m.bit_count() > FEW_BITS]
        hot = keys.where(F.col("mask").isin([_signed(m) for m in parted])).groupBy("mask", "part").count().where(F.col("count") > bucket_limit)
        hot = staged(hot.select("mask", "part"), "hot_buckets")
        any_hot = not hot.isEmpty()
        cold = keys.join(hot, ["mask", "part"], "left_anti") if any_hot else keys
        dealt = cold.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        found = dealt.mapInArrow(_bucket_edges(distance), "a long, b long")
        edges = found if edges is None else edges.unionAll(found)
        if not any_hot:
            return edges.distinct()
        wide = [r["mask"] for r in hot.select("mask").distinct().collect()]  # of the masks, whose number the distance bounds
        finer = {m: block_masks(distance + 2, distance, m & ALL) for m in wide}
        masks = sorted({x for row in finer.values() for x in row})
        table = spark.createDataFrame([(m, [_signed(x) for x in row]) for m, row in finer.items()], "mask long, finer array<long>")
        again = keys.join(hot, ["mask", "part"], "left_semi").join(F.broadcast(table), "mask")
        keys = _keyed(staged(again.select(F.explode("finer").alias("mask"), "fp").distinct(), "finer_keys"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of the edges (a, b)."""
    both = staged(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")

    def weight(table: DataFrame):
        return table.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]

    last = weight(labels)
    while last is not None:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = staged(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = staged(lower.join(jump, "label").select("node", F.col("root").alias("label")), "labels")
        now = weight(labels)  # labels only ever fall
        if now == last:
            break
        last = now
    return labels


def fingerprint_components(marked: DataFrame, distance: int, blocks: int | None, bucket_limit: int) -> DataFrame:
    """fp, component_id for every distinct fp of the rows (doc_id, fp)."""
    first = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct_fp")
    labels = components(close_edges(first.select("fp"), distance, blocks, bucket_limit))
    members = staged(labels.join(first, F.col("node") == F.col("fp")).select("fp", "label", "doc"), "members")
    least = staged(members.groupBy("label").agg(F.min("doc").alias("component_id")), "least_doc")
    linked = staged(members.join(least, "label").select("fp", "component_id", "label"), "linked")
    single = first.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("doc").alias("component_id"), F.col("fp").alias("label"))
    return staged(linked.unionAll(single), "fp_component")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int | None = None, bucket_limit: int = 20000) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    marked = staged(fingerprints(docs, shingle), "fingerprints")
    every = fingerprint_components(marked, distance, blocks, bucket_limit)
    return marked.join(every, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int | None = None, bucket_limit: int = 20000) -> DataFrame:
    """The rows of docs, with all their columns, that stay when every component keeps the row with its least doc_id (a row
    without one only if no other is there, and of several such rows the one whose text has the least hash)."""
    keyed = with_row_key(docs)
    marked = staged(fingerprints(keyed, shingle, keep=("row_key",)), "fingerprints")
    every = fingerprint_components(marked.select("doc_id", "fp"), distance, blocks, bucket_limit)
    first = marked.join(every, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("label").agg(F.min(F.struct("row_key", F.col("doc_id").alias("stay_id"))).alias("x"), F.count("*").alias("n"))
    stay = staged(stay.select("x.stay_id", F.col("x.row_key").alias("stay_key"), F.col("n").alias("times")), "stay")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (F.xxhash64("text") == F.col("stay_key"))
    once = docs.join(stay.where("times = 1").drop("times"), same, "left_semi")
    several = stay.where("times > 1").drop("times")
    if several.isEmpty():
        return once
    twice = docs.join(several, same).dropDuplicates(["stay_id", "stay_key"]).drop("stay_id", "stay_key")
    return once.unionByName(twice)
