"""Language-model scoring: the cross-entropy difference between a target model and a background model.

Tokens are words, runs of anything but space and the control characters from tab to carriage return, with A-Z
lower-cased. Both models are bigram models over one vocabulary, every word of the corpus (or, if `vocabulary` is given,
that many of the most frequent ones and one token for every other word). The target model is counted over the documents
that labels call good, the background model over all documents; the models are matched: the background's counts are scaled
to the target's number of tokens before both are smoothed alike (a bigram's estimate backs off to the word's, the word's to
the uniform one). The loss of a token is the negative logarithm of its probability; a document's score is the mean over
its tokens of target loss less background loss, so a lower score is more like the target.

Documents are dealt into two folds by the hash of their text and each is scored by models that saw the other fold only:
no document is scored by its own counts, nor by those of an exact copy. Labels of rows with crc32(doc_id as text) modulo
5 equal to 0 are not used and can tell how good the scores are.

Method. Documents are dealt by hashes into groups of about `group_bytes` of text, each in one fold. A group counts its
bigrams, words and words before others under 62-bit hashes with two bits for the kind, in rising order and cut into buckets
by their upper bits; a bucket of a group is one row of packed numbers. A bucket adds up its keys over all groups and answers
every group, in the order of the group's keys, with their sums over the other fold; a key has at most one number a group, so
there is no hot key. The documents are dealt once: what counts them and what scores them read the same shuffle. Nothing but
the number of words and four totals goes through the driver, nothing is broadcast but label ids if they are few
(`broadcast_ids`; else they are joined by a shuffle) and a `vocabulary` that is given.

Defined results: a text without words (null, empty, blank) has no tokens and null losses and score; labels without a
doc_id or with any other quality than 1 are no target; without target tokens in a fold the target model is the background
model, so scores there are 0; repeated rows each count and each get a result; a row without a doc_id is never target;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct, distinct_inverse, lowered, mixed, staged, word_hashes, words

FOLDS = 2
#: What a key counts, in its two lowest bits; hashes of the start of a document and of a word that the vocabulary has not.
PAIR, WORD, AHEAD = 0, 1, 2
START, OTHER = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


def _hashed(data, offsets):
    """The rows and hashes of all words."""
    data = lowered(data)
    starts, ends, rows = words(data, offsets)
    return rows, word_hashes(data, starts, ends)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


class Tally:
    """Sums by key that are handed on when they are many."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.held.append(np.unique(keys, return_counts=True))
            self.size += len(self.held[-1][0])
            if self.size > self.limit:
                self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
                self.size = len(self.held[0][0])

    def full(self) -> bool:
        return self.size > self.limit

    def take(self) -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*self.held, strict=True))) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held, self.size = [], 0
        return pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(counts.astype(np.int64))})


def _counted(df: DataFrame, keys_of) -> DataFrame:
    """key, n over all rows: keys_of(batch) gives arrays of keys."""

    def run(batches):
        tally = Tally()
        for batch in batches:
            for keys in keys_of(batch):
                tally.add(keys)
                if tally.full():
                    yield tally.take()
        yield tally.take()

    return df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, size: int) -> np.ndarray:
    """The hashes, in rising order, of the most frequent words."""

    def keys_of(batch):
        for _, _, data, offsets in chunks(batch.column("text")):
            yield _hashed(data, offsets)[1]

    counts = staged(_counted(docs.select("text"), keys_of), "word_counts")
    # a few hundred classes of counts tell how often a word must be there to be among the most frequent, so that tasks hand
    # on about `size` words between them and not `size` words each
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("class")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("class")).collect()
    least, words_so_far = 1, 0
    for c in classes:
        least, words_so_far = c["least"], words_so_far + c["words"]
        if words_so_far >= size:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(size).select("key")
    return np.sort(top.toArrow().column("key").to_numpy().view(np.uint64))  # `size` numbers


def _known(hashes: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """The hashes, with OTHER for those that a vocabulary has not."""
    if known is None or not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, hashes, OTHER)


def _tokens(column: pa.ChunkedArray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and hash of the token before, for all tokens of the texts."""
    of, hashes, first_row = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], 0
    for part in column.chunks:
        for first, _, data, offsets in chunks(part):
            rows, found = _hashed(data, offsets)
            of.append((rows + (first + first_row)).astype(np.int32))
            hashes.append(found)
        first_row += len(part)
    of, hashes = np.concatenate(of), _known(np.concatenate(hashes), known)
    before = np.full(len(hashes), START, np.uint64)
    before[1:] = np.where(of[1:] == of[:-1], hashes[:-1], START)
    return of, hashes, before


def _keys(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & ~np.uint64(3)) | np.uint64(kind)


def _pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _keys(mixed(mixed(before) + after), PAIR)


def flagged(docs: DataFrame, labels: DataFrame, broadcast_ids: int) -> DataFrame:
    """doc_id, text, fold and whether the row is target."""
    good = labels.where("doc_id IS NOT NULL AND quality = 1 AND crc32(CAST(doc_id AS STRING)) % 5 <> 0").select(F.col("doc_id").alias("label_id")).distinct()
    good = staged(good.withColumn("target", F.lit(True)), "good_ids")
    if good.count() <= broadcast_ids:
        good = F.broadcast(good)
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    return rows.join(good, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "fold", F.coalesce("target", F.lit(False)).alias("target"))


def _group_keys(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The distinct keys of a group's tokens, rising."""
    return np.sort(np.concatenate([distinct(k) for k in (_pairs(before, after), _keys(after, WORD), _keys(before, AHEAD))]))


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view(np.uint64).reshape(size)


def grouped(rows: DataFrame, total_bytes: int, group_bytes: int) -> DataFrame:
    """doc_id, text, target, grp: the groups of fold f are f, f + FOLDS, f + 2 * FOLDS and so on."""
    each = -(-total_bytes // (group_bytes * FOLDS)) or 1
    grp = F.col("fold") + FOLDS * F.pmod(F.xxhash64("doc_id", "text"), F.lit(each))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "target", grp.cast("long").alias("grp"))


def totals_of(rows: DataFrame, known) -> tuple[int, dict[int, tuple[int, int]]]:
    """The number of distinct words, and by fold the number of tokens and of those in target documents."""

    def run(batches):
        tally, parts = Tally(), np.zeros(2 * FOLDS, np.int64)

        def out():
            words = tally.take()
            return pa.RecordBatch.from_pydict({"key": words.column("key"), "part": pa.nulls(words.num_rows, pa.int32()), "n": words.column("n")})

        for batch in batches:
            part = batch.column("fold").to_numpy().astype(np.int64) * 2 + batch.column("target").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in chunks(batch.column("text")):
                of, hashes = _hashed(data, offsets)
                parts += np.bincount(part[of + first], minlength=2 * FOLDS)
                tally.add(_keys(_known(hashes, known and known.value), WORD).view(np.int64))
                if tally.full():
                    yield out()
        yield out()
        yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(parts), pa.int64()), "part": pa.array(range(len(parts)), pa.int32()), "n": pa.array(parts)})

    counts = rows.select("text", "fold", "target").mapInArrow(run, "key long, part int, n long").groupBy("key", "part").agg(F.sum("n").alias("n"))
    found = {r.part: r for r in counts.groupBy("part").agg(F.count("key").alias("words"), F.sum("n").alias("n")).collect()}  # 5 rows
    n = [found[p].n if p in found else 0 for p in range(2 * FOLDS)]
    return found[None].words if None in found else 0, {f: (n[2 * f] + n[2 * f + 1], n[2 * f + 1]) for f in range(FOLDS)}


PACKED = "grp long, bucket long, size long, n binary, n_target binary"


def counted(rows: DataFrame, known, buckets: int) -> DataFrame:
    """PACKED and the keys: the counts of every group; known: nothing or a broadcast vocabulary."""

    def run(table: pa.Table) -> pa.Table:
        of, after, before = _tokens(table.column("text"), known and known.value)
        target = table.column("target").to_numpy()[of]
        keys = _group_keys(after, before)
        every, good = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for found in (lambda: _pairs(before, after), lambda: _keys(after, WORD), lambda: _keys(before, AHEAD)):  # one at a time, for memory
            for sums, some in ((every, slice(None)), (good, target)):
                key, n = np.unique(found()[some], return_counts=True)
                sums[np.searchsorted(keys, key)] = n
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(keys)) if len(keys) else heads
        spans, at = list(zip(heads, ends, strict=True)), table.column("grp")[0].as_py()
        packed = [[_pack(x[i:j]) for i, j in spans] for x in (every, good)] + [[_pack(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in spans]]
        binary = [pa.array(x, pa.binary()) for x in packed]
        return pa.table({"grp": np.full(len(heads), at, np.int64), "bucket": bucket[heads].astype(np.int64), "size": (ends - heads).astype(np.int64), "n": binary[0], "n_target": binary[1], "keys": binary[2]})

    return rows.groupBy("grp").applyInArrow(run, f"{PACKED}, keys binary")


def elsewhere(counts: DataFrame) -> DataFrame:
    """PACKED: for the keys of every group and bucket, in their order, the sums over the other fold's groups."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        keys = np.concatenate([np.cumsum(_unpack(k, n), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        is_zero = np.repeat(table.column("grp").to_numpy() % FOLDS == 0, sizes)
        every, _, which = distinct_inverse(keys)
        ends, out = np.cumsum(sizes), {}
        for name in ("n", "n_target"):
            n = np.concatenate([_unpack(c, k) for c, k in zip(table.column(name).to_pylist(), sizes, strict=True)]).astype(np.float64)
            zero, one = (np.bincount(which[of], n[of], len(every))[which] for of in (is_zero, ~is_zero))
            answer = np.where(is_zero, one, zero)
            out[name] = pa.array([_pack(answer[j - k : j]) for j, k in zip(ends, sizes, strict=True)], pa.binary())
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "size": table.column("size")} | out)

    return counts.groupBy("bucket").applyInArrow(run, PACKED)


def _losses(count, word, ahead, total, scale: float, size: int, word_weight: float, pair_weight: float) -> np.ndarray:
    """The losses of bigrams from their counts, those of the word and those of the word before."""
    unigram = (word * scale + word_weight / (size + 1)) / (total * scale + word_weight)
    return -np.log((count * scale + pair_weight * unigram) / (ahead * scale + pair_weight))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, vocabulary: int | None = None, word_weight: float = 100.0, pair_weight: float = 50.0, broadcast_ids: int = 1 << 20, group_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for every row of docs (doc_id, text)."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary_of(docs, vocabulary))
    total_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marked = flagged(docs, labels, broadcast_ids)
    distinct, totals = totals_of(marked, known)
    size = len(known.value) if known else distinct
    rows = grouped(marked, total_bytes, group_bytes)
    answers = elsewhere(counted(rows, known, -(-2 * total_bytes // group_bytes) or 1))

    def scored(texts: pa.Table, sums: pa.Table) -> pa.Table:
        of, after, before = _tokens(texts.column("text"), known and known.value)
        n = np.bincount(of, minlength=texts.num_rows)
        none = n == 0
        out = {"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64))}
        a = b = np.zeros(texts.num_rows)
        if len(of):
            keys, sums = _group_keys(after, before), sums.sort_by("bucket")
            every, target = (np.concatenate([_unpack(c, k) for c, k in zip(sums.column(x).to_pylist(), sums.column("size").to_pylist(), strict=True)]).astype(np.float64) for x in ("n", "n_target"))
            if len(every) != len(keys):
                raise ValueError(f"{len(every)} sums for {len(keys)} keys")
            pairs, first, which = distinct_inverse(_pairs(before, after))
            at = [np.searchsorted(keys, k) for k in (pairs, _keys(after[first], WORD), _keys(before[first], AHEAD))]
            total, good = totals[FOLDS - 1 - texts.column("grp")[0].as_py() % FOLDS]
            background = _losses(*(every[i] for i in at), total, good / max(1, total) if good else 1.0, size, word_weight, pair_weight)
            near = _losses(*(target[i] for i in at), good, 1.0, size, word_weight, pair_weight) if good else background
            a, b = (np.bincount(of, x[which], texts.num_rows) / np.maximum(n, 1) for x in (near, background))
        return pa.table(out | {"loss_target": pa.array(a, mask=none), "loss_background": pa.array(b, mask=none), "score": pa.array(a - b, mask=none)})

    schema = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    return rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(scored, schema)
