"""Hard negatives by norm-bucketed search: for each anchor and positive the highest-scoring rows of other labels in a window.

Scores are integer inner products of floor(scale * x). An anchor's positives are its first `positives` other rows of its
label; a positive's negatives are the first `negatives` rows of other labels whose score is from low to high of the
positive's, both as hundredths. Higher scores come first, ties by smaller vec_id.

Method. Candidates are sorted by norm in ranges and packed in buckets of `bucket_rows`, each a row with its greatest norm.
By Cauchy-Schwarz no row of a bucket scores more than |anchor| times that norm. A cell, which is a block of anchors and a
slice of buckets, takes the buckets from the longest to the shortest and leaves out, for each anchor, those whose bound is
below the lower limit of its window or below its running k-th score; as norms fall, what is left out stays out. The cells' answers
are put together by a window of k rows a cell. Positives are the search with the own label and no window; the negatives
follow with the windows that the positives give.

Anchors and candidates are both dealt, as rows, to cells of bounded bytes (`block_rows`, `cell_bytes`): nothing is broadcast or
collected but sums of sizes by length of vector. A slice gets buckets of all lengths in turn. Every row is met by every
block of anchors, which is the query set asked for; how often the candidates are copied is the number of blocks.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; rows that share
a vec_id are rows of their own, also to each other; a row meets only vectors of its own length; with fewer rows than asked
for, all are given; scores may be of any size: one that 64 bits cannot hold is ranked and compared by its true value and
given as the nearest number that they can; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .topk_search import _any_size, _as_floats, _beyond, _most, products, whole_numbers

BUCKET_ROWS, BLOCK_ROWS, CELL_BYTES = 1024, 1 << 16, 64 << 20
#: Anchors that are scored against a bucket at once.
ANCHORS = 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ANSWERS = "anchor long, nth int, row long, vec_id long, score long, rest binary"


def labelled(vectors: DataFrame, every: int = 0, labels: int = 10) -> DataFrame:
    """vectors (vec_id, embedding, label) with the next label, of `labels`, where `every` divides vec_id."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if every else F.col("label")
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def numbered(vectors: DataFrame) -> DataFrame:
    """vec_id, label, row, x (array<double>), dim of the vectors that take part; row tells apart rows that share an id."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fit)
    x = F.col("embedding").cast("array<double>")
    return staged(rows.select("vec_id", "label", F.monotonically_increasing_id().alias("row"), x.alias("x"), F.size("embedding").alias("dim")), "vectors")


# Buckets ------------------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers in as few bytes as hold them; beyond 53 bits, and for numbers of any size, none."""
    top = _most(x)
    for kind, most in (("<i2", 2**15), ("<i4", 2**31), ("<f8", 2**53)):
        if x.dtype != object and top < most:
            return x.astype(kind).tobytes(), kind
    return b"", ""


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, rounded up; without end where doubles may not hold them."""
    at = _as_floats(x)
    out = np.sqrt((np.clip(at, -1e150, 1e150) ** 2).sum(axis=1)) * (1 + 2.0**-40 * (x.shape[1] + 8)) + 1e-6
    return np.where(np.abs(at).max(axis=1, initial=0.0) < 1e150, out, np.inf)


def _matrix(x: pa.ChunkedArray | pa.Array, dim: int, scale: int) -> np.ndarray:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    return whole_numbers(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dim), scale)


def buckets(rows: DataFrame, scale: int, bucket_rows: int) -> DataFrame:
    """dim, top (the greatest norm), ids, labels, keys, and data: whole numbers as `kind`, or the doubles that they are made of."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            dim = table.column("dim")[0].as_py()
            raw = table.column("x").combine_chunks().flatten().to_numpy().astype("<f8")
            x = whole_numbers(raw.reshape(table.num_rows, dim), scale)
            data, kind = _packed(x)
            names = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label", "row")]
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "top": [float(_norms(x).max(initial=0.0))], **dict(zip(("ids", "labels", "keys"), ([n] for n in names), strict=True)), "data": [data or raw.tobytes()], "kind": [kind]})

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            dims = table.column("dim").to_numpy()
            bounds = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            held.clear()
            for a, b in zip(bounds, bounds[1:], strict=False):
                at = a
                while b - at >= bucket_rows or (at < b and (last or b < len(dims))):
                    yield out(table.slice(at, min(bucket_rows, b - at)))
                    at = min(b, at + bucket_rows)
                if at < b:
                    held.append(table.slice(at, b - at))

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) >= bucket_rows:
                    yield from full(False)
        if held:
            yield from full(True)

    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    ranges = rows.withColumn("norm", norm).repartitionByRange("dim", F.desc("norm"), "row").sortWithinPartitions("dim", F.desc("norm"), "row")
    packed = ranges.select("vec_id", "label", "row", "x", "dim").mapInArrow(pack, "dim int, top double, ids binary, labels binary, keys binary, data binary, kind string")
    return staged(packed.withColumn("bucket", F.monotonically_increasing_id()), "buckets")


# Cells --------------------------------------------------------------------------------------------------------------


class Windows:
    """Windows of one block: anchor (its place), low and high of scores, and the k best rows of each so far."""

    def __init__(self, anchor: np.ndarray, low: list[int], high: list[int], k: int, wide: bool):
        self.anchor, self.k = anchor, k
        kind = object if wide else np.int64
        self.low, self.high = np.array(low, kind), np.array(high, kind)
        self.kth = self.low.copy()  # no score below it is of use
        self.window = np.zeros(0, np.int64)
        self.score, self.row, self.vec_id = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def limits(self, anchors: int) -> np.ndarray:
        """The least score that is of use to each anchor (as doubles, rounded down); without end where none is."""
        out = np.full(anchors, np.inf)
        np.minimum.at(out, self.anchor, np.nextafter(_as_floats(self.kth), -np.inf))
        return out

    def add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(window):
            return
        window, score, row, vec_id = (np.concatenate([a, b]) for a, b in ((self.window, window), (self.score, score), (self.row, row), (self.vec_id, vec_id)))
        order = np.lexsort((row, vec_id, -score, window))
        window = window[order]
        heads = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        nth = np.arange(len(window)) - np.repeat(heads, np.diff([*heads, len(window)]))
        best = order[nth < self.k]
        self.window, self.score, self.row, self.vec_id = window[nth < self.k], score[best], row[best], vec_id[best]
        full = nth == self.k - 1
        self.kth[window[full]] = np.maximum(self.kth[window[full]], score[order[full]])


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; in single precision where that is exact."""
    if anchors.dtype != object and rows.dtype != object and _most(anchors) * _most(rows) * max(1, anchors.shape[1]) < 2.0**24:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    return products(anchors, rows)


def searched(anchors: pa.Table, slices: pa.Table, scale: int, k: int, own_label: bool, wide: bool) -> pa.Table:
    """The k best rows of a slice for each window of a block of anchors (anchor, label, x, low, high: a list entry a window)."""
    dim = anchors.column("dim")[0].as_py()
    keys, labels = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy()
    x = _matrix(anchors.column("x"), dim, scale)
    norms = _norms(x)
    lows, highs = anchors.column("low").to_pylist(), anchors.column("high").to_pylist()
    windows = Windows(np.repeat(np.arange(len(keys)), [len(w) for w in lows]), [int(v) for w in lows for v in w], [int(v) for w in highs for v in w], k, wide)
    nth = np.array([i for w in lows for i in range(len(w))], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in lows])]).astype(np.int64)
    for at in np.argsort(-slices.column("top").to_numpy(), kind="stable").tolist():
        row = {c: slices.column(c)[at].as_py() for c in ("top", "ids", "labels", "keys", "data", "kind")}
        with np.errstate(invalid="ignore", over="ignore"):
            bound = norms * row["top"] + 1.0
        bound = np.where(np.isnan(bound), np.inf, bound)
        some = np.flatnonzero(bound >= windows.limits(len(keys)))
        if not len(some):
            continue
        ids, theirs, rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "keys"))
        data = np.frombuffer(row["data"], row["kind"] or "<f8").reshape(len(ids), dim)
        data = data.astype(np.float64) if row["kind"] else whole_numbers(data, scale)
        for first in range(0, len(some), ANCHORS):
            part = some[first : first + ANCHORS]
            scores = _scores(x[part], data)
            scores = _any_size(scores) if wide else scores
            like = labels[part][:, None] == theirs[None, :]
            open_ = (like if own_label else ~like) & (keys[part][:, None] != rows[None, :])
            # windows of these anchors, and for each the anchor's line
            of = np.concatenate([np.arange(starts[a], starts[a + 1]) for a in part.tolist()]) if len(part) else np.zeros(0, np.int64)
            line = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            fits = open_[line] & (scores[line] >= windows.kth[of][:, None]) & (scores[line] <= windows.high[of][:, None])
            if not wide and fits.shape[1] > k:  # of each window the k best of this bucket, and those equal to the last
                least = np.partition(np.where(fits, scores[line], LEAST), -k, axis=1)[:, -k]
                fits &= scores[line] >= least[:, None]
            w, c = np.nonzero(fits)
            windows.add(of[w], scores[line[w], c], rows[c], ids[c])
    score, rest = windows.score, [b""] * len(windows.score)
    if wide:
        rest = [_beyond(s) for s in score.tolist()]
        score = np.array([min(MOST, max(LEAST, s)) for s in score.tolist()], np.int64)
    return pa.table({"anchor": keys[windows.anchor[windows.window]], "nth": pa.array(nth[windows.window], pa.int32()), "row": windows.row, "vec_id": windows.vec_id, "score": pa.array(score, pa.int64()), "rest": pa.array(rest, pa.binary())})


def _true(score: int, rest: bytes) -> int:
    """The score that `rest` (see topk_search) tells, if it does."""
    if not rest:
        return score
    raw = rest if score > 0 else bytes(255 - x for x in rest)
    return int.from_bytes(raw[4:], "big") * (1 if score > 0 else -1)


class Search:
    """Candidates in buckets and the sizes of cells."""

    def __init__(self, rows: DataFrame, scale: int, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, cell_bytes: int = CELL_BYTES):
        self.scale, self.block_rows, self.cell_bytes = scale, block_rows, cell_bytes
        size = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max("dim").alias("dim"), F.sum(F.col("dim") * 8 + 32).alias("bytes")).first()
        most, self.dim = size["most"] or 0.0, size["dim"] or 0
        self.wide = most >= 1e100 or (most * scale + 1) ** 2 * self.dim >= 2.0**62
        self.buckets = buckets(rows, scale, bucket_rows)
        self.slices = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // cell_bytes))

    def answers(self, anchors: DataFrame, k: int, own_label: bool) -> DataFrame:
        """anchor, nth, row, vec_id, score, rest, rank: the k best for each window of anchors (anchor, label, x, dim, low, high)."""
        scale, wide, slices = self.scale, self.wide, self.slices
        per_block = max(1, min(self.block_rows, self.cell_bytes // (8 * self.dim + 64)))
        blocks = max(1, -(-anchors.count() // per_block))
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        spread = self.buckets.withColumn("slice", F.pmod(F.xxhash64("bucket"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return EMPTY
            return searched(left, right, scale, k, own_label, wide)

        keys = ("dim", "block", "slice")
        found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(cell, ANSWERS)
        order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.desc("rest"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


EMPTY = pa.table({"anchor": pa.array([], pa.int64()), "nth": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "rest": pa.array([], pa.binary())})


def _limits(low: int, high: int):
    """The least and the greatest score of each positive's window, as text (of any size)."""

    @F.udf("struct<low array<string>, high array<string>>")
    def limits(scores, rests):
        true = [_true(s, bytes(r)) for s, r in zip(scores, rests, strict=True)]
        return [str(-(-low * s // 100)) for s in true], [str(high * s // 100) for s in true]

    return limits


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, which are the rows of vectors
    (vec_id, embedding, label) whose id is divisible by `every`. sizes: bucket_rows, block_rows, cell_bytes."""
    rows = numbered(vectors)
    search = Search(rows, scale, **sizes)
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x", "dim")
    beyond = 1 << 3000 if search.wide else 1 << 62
    anywhere = [F.array(F.lit(str(v))).alias(n) for n, v in (("low", -beyond), ("high", beyond))]
    near = staged(search.answers(anchors.drop("anchor_id").select("*", *anywhere), positives, own_label=True), "positives")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "rest")))
    per_anchor = near.groupBy("anchor").agg(in_order.alias("near"))
    both = anchors.join(per_anchor, "anchor").withColumn("limits", _limits(low, high)("near.score", "near.rest"))
    wanted = staged(both.select("anchor", "anchor_id", "label", "x", "dim", F.col("limits.low").alias("low"), F.col("limits.high").alias("high"), "near"), "windows")
    found = search.answers(wanted.select("anchor", "label", "x", "dim", "low", "high"), negatives, own_label=False)
    names = wanted.select("anchor", "anchor_id", F.posexplode("near").alias("nth", "near"))
    out = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(names, ["anchor", "nth"])
    return out.select("anchor_id", F.col("near.vec_id").alias("positive_id"), "rank", "negative_id", F.col("near.score").alias("positive_score"), "negative_score")
