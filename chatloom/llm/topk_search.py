"""Exact top-k search by integer inner product: ball trees, branch and bound.

A vector's components become floor(scale * x). A query's answers are the k rows with the highest inner products, ties to
the smaller vec_id, its own row left out.

Method. Vectors are dealt to shards by the hash of their row and each shard keeps a ball tree of them. A ball with centre
c and radius r bounds the inner products with q by q.c + |q| r, so a search takes the child with the higher bound first
and leaves out balls bounded below the k-th best score so far. Queries go in waves of at most `wave` rows and WAVE_BYTES,
which bounds what is broadcast, however long the vectors. In a wave every shard first answers from the leaf that its tree likes best; the k-th best of those
answers over all shards is a floor under each query's k-th score, which all shards share in the search proper. A task
takes its shards one after another and carries the k best of each query from shard to shard, so it hands on k rows a
query, however many shards it has.

Scores are sums of float products where these are exact, of 64-bit products where those are, and of whole numbers of any
size elsewhere; which of them is decided leaf by leaf.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id;
rows that share a vec_id are rows of their own, as queries and as candidates, also of each other; a query meets only
vectors of its own length; with fewer candidates than k all are given; a score that 64 bits cannot hold is ranked by its
true value and given as the nearest number that they can; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, staged

LEAF = 64
BLOCK = 4096
#: Bytes of the queries that are sent to every task at once.
WAVE_BYTES = 32 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
NOBODY = MOST
#: Below every score: of 64 bits, and of any size.
LOWEST, LOWEST_OF_ALL = LEAST, -(1 << 4000)


def numbered(vectors: DataFrame) -> DataFrame:
    """vec_id, row, x (array<double>) of the vectors that take part; row tells apart rows that share an id."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fit)
    return staged(rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("x")), "vectors")


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole doubles, or as integers of any size where a double is not enough."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    return np.array([int(v) * scale if abs(v) > 2.0**60 else math.floor(v * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _any_size(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _as_floats(x: np.ndarray) -> np.ndarray:
    """Doubles no greater than the numbers, but for rounding."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([-np.inf if v <= -(1 << 1023) else min(v, (1 << 1023)) for v in x.ravel().tolist()], np.float64).reshape(x.shape)


def _most(x: np.ndarray) -> float:
    return float(np.abs(_as_floats(x)).max(initial=0.0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: integers of 64 bits, or of any size if they may need it."""
    top = _most(queries) * _most(rows) * queries.shape[1]
    if top < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    if top < 2.0**62 and queries.dtype != object and rows.dtype != object:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    return np.dot(_any_size(queries), _any_size(rows).T) if queries.shape[1] else np.zeros((len(queries), len(rows)), object)


class BallTree:
    """Rows in the order of the leaves; a node is a range of them with a centre and a radius."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        order, self.nodes, self.centres, self.radii = np.arange(len(ids)), [], [], []
        at = np.clip(_as_floats(rows), -1e150, 1e150)  # what bounds are made of; see `sound`
        self.sound = bool((np.abs(at) < 1e150).all())
        slack = 2.0**-48 * (rows.shape[1] + 8)
        stack = [(0, len(ids), None)]
        while stack:
            a, b, parent = stack.pop()
            own = at[order[a:b]]
            centre = own.mean(axis=0)
            gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            self.centres.append(centre)
            self.radii.append(gap.max() * (1 + 1e-9) + 1e-6 + slack * np.abs(own).max(initial=0.0))
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = me
            if b - a > LEAF:
                far = own[gap.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                middle = (b - a) // 2  # halves, however many vectors are equal
                order[a:b] = order[a:b][np.argsort(own @ (far - other), kind="stable")]
                stack += [(a, a + middle, (me, 2)), (a + middle, b, (me, 3))]
        self.ids, self.keys, self.rows = ids[order], keys[order], rows[order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.slack = slack * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii) if self.sound else self.radii

    def bounds(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Of every inner product below the node, rounding counted in; no bound at all where doubles may not hold it."""
        if not self.sound:
            return np.full(len(queries), np.inf)
        return queries @ self.centres[node] + norms * (self.radii[node] + self.slack[node]) + 1e-3


class Best:
    """The k best rows so far of each query of one block, from one tree after another."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, wide: bool):
        self.ids, self.keys, self.queries, self.floors, self.k = ids, keys, queries, floors, k
        self.at = np.clip(_as_floats(queries), -1e150, 1e150)
        self.norms = np.sqrt((self.at**2).sum(axis=1))
        self.sound = np.abs(self.at).max(axis=1, initial=0.0) < 1e150
        self.lowest = LOWEST_OF_ALL if wide else LOWEST
        self.scores = np.full((len(ids), k), self.lowest, object if wide else np.int64)
        self.found = np.full((len(ids), k), NOBODY)
        self.has = np.zeros((len(ids), k), bool)

    def limits(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[some, -1], self.floors[some])

    def leaf(self, tree: BallTree, node: int, some: np.ndarray) -> None:
        a, b = tree.nodes[node][:2]
        scores = products(self.queries[some], tree.rows[a:b]).astype(self.scores.dtype)
        other = self.keys[some][:, None] != tree.keys[None, a:b]
        scores[~other] = self.lowest
        better = scores.max(axis=1) >= self.limits(some)
        some, scores, other = some[better], scores[better], other[better]
        if not len(some):
            return
        every = np.concatenate([self.scores[some], scores], axis=1)
        names = np.concatenate([self.found[some], np.where(other, tree.ids[None, a:b], NOBODY)], axis=1)
        has = np.concatenate([self.has[some], other], axis=1)
        best = np.lexsort((names, -np.maximum(every, self.lowest + 1), ~has), axis=-1)[:, : self.k]
        self.scores[some], self.found[some], self.has[some] = (np.take_along_axis(x, best, 1) for x in (every, names, has))

    def _halves(self, tree: BallTree, node: int, some: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The children, and the queries that like each better."""
        left, right = tree.nodes[node][2:]
        likes_left = tree.bounds(left, self.at[some], self.norms[some]) >= tree.bounds(right, self.at[some], self.norms[some])
        return [(left, some[likes_left]), (right, some[~likes_left])]

    def visit(self, tree: BallTree) -> None:
        stack = [(0, np.arange(len(self.ids)))]
        while stack:
            node, some = stack.pop()
            bound = tree.bounds(node, self.at[some], self.norms[some])
            some = some[~self.sound[some] | (bound >= _as_floats(self.limits(some)))]
            if not len(some):
                continue
            if tree.nodes[node][2] < 0:
                self.leaf(tree, node, some)
                continue
            (left, lefts), (right, rights) = self._halves(tree, node, some)
            stack += [(x, q) for x, q in ((left, rights), (right, lefts), (right, rights), (left, lefts)) if len(q)]  # the last is next

    def first_leaf(self, tree: BallTree) -> None:
        stack = [(0, np.arange(len(self.ids)))]
        while stack:
            node, some = stack.pop()
            if tree.nodes[node][2] < 0:
                self.leaf(tree, node, some)
            else:
                stack += [x for x in self._halves(tree, node, some) if len(x[1])]

    def answers(self) -> pa.RecordBatch:
        q, rank = np.nonzero(self.has)
        scores = self.scores[q, rank]
        rest = [b""] * len(q)
        if scores.dtype == object:
            rest = [_beyond(s) for s in scores.tolist()]
            scores = np.array([min(MOST, max(LEAST, s)) for s in scores.tolist()], np.int64)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(self.ids[q]), "query": pa.array(self.keys[q]), "vec_id": pa.array(self.found[q, rank]), "score": pa.array(scores, pa.int64()), "rest": pa.array(rest, pa.binary())})


def _beyond(score: int) -> bytes:
    """Bytes that rise with scores that 64 bits do not hold; none for the others."""
    if LEAST < score < MOST:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - x for x in raw)


def ball_trees(vectors: DataFrame, scale: int, shard_rows: int) -> DataFrame:
    """dim, tree (a pickled BallTree) of every shard of about shard_rows vectors."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(key, table):
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        rows = whole_numbers(table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, key[0].as_py()), scale)
        tree = BallTree(table.column("vec_id").to_numpy(), table.column("row").to_numpy(), rows)
        return pa.table({"dim": pa.array([rows.shape[1]], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = vectors.select("vec_id", "row", "x", F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    return staged(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, tree binary"), "ball_trees")


def _answers(trees: DataFrame, blocks, k: int, wide: bool, only_first: bool) -> DataFrame:
    """query_id, query (its row), vec_id, score, rest: each task's k best for the broadcast blocks (dim: ids, rows, queries, floors)."""

    def search(batches):
        held: dict[int, list[Best]] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("tree"), strict=True):
                if dim not in blocks.value:
                    continue
                if dim not in held:
                    parts = blocks.value[dim]
                    held[dim] = [Best(*(x[i : i + BLOCK] for x in parts), k, wide) for i in range(0, len(parts[0]), BLOCK)]
                tree = pickle.loads(raw.as_py())
                for best in held[dim]:
                    best.first_leaf(tree) if only_first else best.visit(tree)
        for bests in held.values():
            for best in bests:
                yield best.answers()

    return trees.mapInArrow(search, "query_id long, query long, vec_id long, score long, rest binary")


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("rest"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = 4096, wave: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose id is divisible by `every`."""
    context = vectors.sparkSession.sparkContext
    rows = numbered(vectors)
    size = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max(F.size("x")).alias("dim")).first()
    wide = ((size["most"] or 0.0) * scale + 1) ** 2 * (size["dim"] or 0) >= 2.0**62 if (size["most"] or 0.0) < 1e100 else True
    trees = ball_trees(rows, scale, shard_rows)
    queries = rows.where(F.col("vec_id") % every == 0)
    wave = max(1, min(wave, WAVE_BYTES // (8 * (size["dim"] or 0) + 64)))
    waves = max(1, -(-queries.count() // wave))
    lowest = LOWEST_OF_ALL if wide else LOWEST
    out = None
    for this in range(waves):
        own = queries.where(F.pmod(F.xxhash64(F.lit(7), F.col("row")), F.lit(waves)) == this).toArrow()  # about `wave` rows
        dims = own.column("x").combine_chunks().value_lengths().to_numpy() if own.num_rows else np.zeros(0, np.int64)
        blocks = {}
        for dim in np.unique(dims).tolist():
            mine = own.take(pa.array(np.flatnonzero(dims == dim)))
            x = whole_numbers(mine.column("x").combine_chunks().flatten().to_numpy().reshape(mine.num_rows, dim), scale)
            blocks[dim] = [mine.column("vec_id").to_numpy(), mine.column("row").to_numpy(), x, np.full(mine.num_rows, lowest, object if wide else np.int64)]
        first = _best(_answers(trees, context.broadcast(blocks), k, wide, True), k).where(F.col("rank") == k).select("query", "score").toArrow()
        floor = {q: s for q, s in zip(first.column("query").to_pylist(), first.column("score").to_pylist(), strict=True) if s > LEAST}
        for held in blocks.values():
            held[3] = np.array([floor.get(i, lowest) for i in held[1].tolist()], held[3].dtype)
        found = _best(_answers(trees, context.broadcast(blocks), k, wide, False), k).select("query_id", "rank", "vec_id", "score")
        found = staged(found, "answers") if waves > 1 else found
        out = found if out is None else out.unionAll(found)
    return out
