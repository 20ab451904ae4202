"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features, ridge regression, isotonic calibration.

Method. A document becomes some thirty statistics of its bytes, words and lines. Random Fourier features turn them into
`features` cosines whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal
equations and the sums are added up, so the ridge fit needs one small matrix whatever the input; scores of a calibration
share of the labelled rows are counted in bins and pooled into a rising function, through which every score goes.

Labels teach from a bounded sample of at most about `max_rows` rows, chosen by the hash of their id among those whose
crc32(doc_id as text) modulo 5 is not 0. Rows of remainder 1 calibrate, the others fit. doc_id, lang, source and labels
are never inputs of a score.

Defined results: null and empty texts have the statistics of an empty text and get a score; labels that are null or not
0 or 1, or without a doc_id, are left out, and of several for one doc_id the least counts; without labels of both kinds
every score is the share of good ones (0.5 without any); a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, in_arrow, lowered, staged, word_hashes, words

HELD_OUT, CALIBRATE, FOLDS = 0, 1, 5
_KINDS = {"upper": (65, 90), "lower": (97, 122), "digit": (48, 57), "other": (128, 255)}
_BRACKETS = "#$%&*+<=>@[]^_{|}~\\/"
_POINTS = ".,;:!?'\"()-"
BINS = 512


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct values and the count of the most frequent."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]))
    size = np.diff(np.append(heads, len(rows)))
    most = np.zeros(n)
    np.maximum.at(most, rows[heads], size)
    return np.bincount(rows[heads], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One line of statistics for each row of a chunk."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    of = np.repeat(np.arange(n), np.diff(offsets))
    one = np.maximum(size, 1)

    def share(table):
        return np.bincount(of[table[data]], minlength=n) / one

    def table_of(codes):
        table = np.zeros(256, bool)
        table[list(codes)] = True
        return table

    cols = [np.log1p(size)]
    cols += [share(table_of(range(a, b + 1))) for a, b in _KINDS.values()]
    cols += [share(table_of(map(ord, x))) for x in (_BRACKETS, _POINTS, "!?", " \t\n\r\x0b\x0c", "|")]

    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=n).astype(float)
    each, length = np.maximum(count, 1), (ends - starts).astype(float)
    mean = np.bincount(rows, length, n) / each
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / each - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    hashes = word_hashes(lowered(data), starts, ends)
    kinds, most = _distinct(rows, hashes, n)
    pairs = gram_hashes(hashes, 2)
    inside = rows[:-1] == rows[1:] if len(rows) else np.zeros(0, bool)
    pair_kinds, _ = _distinct(rows[:-1][inside], pairs[inside], n)
    same = inside & (hashes[1:] == hashes[:-1])
    again = np.bincount(rows[1:][same], minlength=n) if len(rows) else np.zeros(n)
    runs = np.flatnonzero(np.concatenate([[True], ~same])) if len(rows) else np.zeros(0, np.int64)
    longest_run = np.zeros(n)
    np.maximum.at(longest_run, rows[runs], np.diff(np.append(runs, len(rows))))
    capitals = np.concatenate([[0], np.cumsum(table_of(range(65, 91))[data])])
    small = np.concatenate([[0], np.cumsum(table_of(range(97, 123))[data])])
    signs = np.concatenate([[0], np.cumsum(table_of(map(ord, _BRACKETS + "!"))[data])])
    loud = (capitals[ends] - capitals[starts] > 1) & (small[ends] == small[starts])
    marked = signs[ends] > signs[starts]
    pointed = table_of(map(ord, ".,;:!?"))[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    first_big = table_of(range(65, 91))[data[starts]] if len(starts) else np.zeros(0, bool)
    cols += [np.log1p(count), mean, spread, np.log1p(longest), kinds / each, np.log1p(kinds) - np.log1p(count), most / each, pair_kinds / np.maximum(count - 1, 1), again / each]
    cols += [np.bincount(rows[x], minlength=n) / each for x in (loud, marked, pointed, first_big, length == 1, length > 15)]
    # shares are small where a part of a long text is junk; counts are not
    cols += [np.log1p(longest_run), np.log1p(again)] + [np.log1p(np.bincount(rows[x], minlength=n)) for x in (loud, marked)]

    line = np.ones(256, bool)
    line[10] = False
    starts, ends, rows = words(data, offsets, line)
    lines = np.bincount(rows, minlength=n).astype(float)
    every, length = np.maximum(lines, 1), (ends - starts).astype(float)
    line_kinds, _ = _distinct(rows, word_hashes(data, starts, ends), n)
    mean = np.bincount(rows, length, n) / every
    cols += [np.log1p(lines), np.log1p(mean), line_kinds / every, np.bincount(rows[length < 20], minlength=n) / every]
    return np.stack(cols, axis=1)


N_STATISTICS = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


class Fit:
    """What a score needs: the scaling of statistics, the random features, the ridge weights, the calibration."""

    def __init__(self, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.turn = rng.normal(size=(N_STATISTICS, features)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        self.weights = np.zeros(features + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        cosines = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def pooled(at: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: rising (place, share) steps."""
    blocks: list[list[float]] = []
    for x, g, t in zip(at, good, total, strict=True):
        blocks.append([x * t, g, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def _fold(column):
    return F.crc32(F.col(column).cast("string")) % FOLDS


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """quality, fold and x, the statistics, of the sampled labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    known = known.withColumn("fold", _fold("label_id")).where(F.col("fold") != HELD_OUT)
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit(11), F.col("label_id")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "quality", F.col("fold").cast("int").alias("fold"))  # max_rows rows of three numbers

    def measured(batch):
        for first, end, data, offsets in chunks(batch.column("text")):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_pydict({"quality": batch.column("quality").slice(first, end - first).cast(pa.int32()), "fold": batch.column("fold").slice(first, end - first), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return in_arrow(rows, measured, "quality int, fold int, x array<double>")


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 3) -> Fit:
    model = Fit(features, width, seed)
    rows = staged(labelled_statistics(docs, labels, max_rows), "labelled")
    moments = rows.select("quality", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), F.avg("quality").alias("good")).collect()  # a row for each statistic
    if not moments:
        return model
    for r in moments:
        model.mean[r["i"]], model.spread[r["i"]] = r["mean"], r["spread"] if r["spread"] and r["spread"] > 1e-9 else 1.0
    model.steps = (np.array([0.0]), np.array([moments[0]["good"]]))

    def equations(batches):
        left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z, y = model.mapped(_matrix(batch)), batch.column("quality").to_numpy() * 2.0 - 1
                left += z.T @ z
                right += z.T @ y
        # a line of the sums is one row, so the adding up is spread over tasks
        yield pa.RecordBatch.from_pydict({"line": pa.array(np.arange(features + 1)), "sums": pa.array(list(np.concatenate([left, right[:, None]], axis=1)), pa.list_(pa.float64()))})

    def added(key, table):
        total = np.sum([np.asarray(x.values) for x in table.column("sums")], axis=0)
        return pa.table({"line": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.where(F.col("fold") != CALIBRATE).mapInArrow(equations, "line long, sums array<double>")
    system = parts.groupBy("line").applyInArrow(added, "line long, sums array<double>").toArrow().sort_by("line")  # features + 1 rows
    lines = np.array(system.column("sums").to_pylist())
    scale = lines[-1, -2]  # the number of rows, from the constant feature
    if scale < 2:
        return model
    model.weights = np.linalg.solve(lines[:, :-1] + ridge * scale / features * np.eye(features + 1), lines[:, -1])

    def binned(batch):
        raw = model.raw(_matrix(batch))
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip((raw + 2) / 4 * BINS, 0, BINS - 1).astype(np.int32)), "raw": pa.array(raw), "quality": batch.column("quality")})

    bins = in_arrow(rows.where(F.col("fold") == CALIBRATE), binned, "bin int, raw double, quality int")
    bins = bins.groupBy("bin").agg(F.avg("raw").alias("at"), F.sum("quality").alias("good"), F.count("*").alias("total")).orderBy("bin").collect()  # BINS rows at most
    if bins:
        # half a row of either kind at the ends: a certain score needs many rows behind it
        at, good, total = (np.array([float(r[x]) for r in bins]) for x in ("at", "good", "total"))
        good[0], total[0], good[-1], total[-1] = good[0] + 0.05, total[0] + 0.1, good[-1] + 0.05, total[-1] + 0.1
        model.steps = pooled(at, good, total)
    return model


def scored(docs: DataFrame, model: Fit, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the `keep` columns) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x for x in keep if x not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names)
    with_text = "text" in keep
    schema = "doc_id long, score double" + ", text string" * with_text + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def judge(batch):
        for first, end, data, offsets in chunks(batch.column("text")):
            part = batch.slice(first, end - first)
            out = {"doc_id": part.column("doc_id"), "score": pa.array(shared.value.score(statistics(data, offsets)))}
            if with_text:
                out["text"] = part.column("text")
            yield pa.RecordBatch.from_pydict(out | {x: part.column(x) for x in names})

    out = in_arrow(rows, judge, schema)
    return out.select("doc_id", F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[x for x in keep if x != "doc_id"])
