"""Best-fit packing: documents as token ids, packed into sequences of at most `capacity` tokens.

A document is the ids of its text and one end id. Only documents of more than `capacity` ids are cut, into pieces of
`capacity`, of which the first may be shorter.

Method. Best-fit decreasing over all pieces at once: a segment tree over remaining capacities finds the tightest open
sequence in logarithmic time. Pieces of one length are interchangeable and so are open sequences with one remaining
capacity, so the tree is asked for groups of them; the result is that of placing one piece after another. What it needs
from the corpus is the number of pieces of each length, `capacity` numbers at most, and what it gives is a plan of
ranges of ranks within a length, whose size depends on `capacity` alone. Pieces learn their rank within their length
from their place in their partition and from the running sums of the partitions' counts, and read their sequence off the
broadcast plan.

The encoder's matcher gives up on white space of some hundred thousand characters. Such runs are one piece each but for
the last character, which what follows may take, so they are encoded by themselves and the text around them as ever.

Defined results: a null text is an empty text, whose only id is the end id; rows without a doc_id or with a repeated one
are packed like any other; a text may hold runs of any length; no rows give no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, staged

# The special token, and what the vocabulary's pattern takes for white space.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_encoders: dict[str, object] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level encoder of a rank file; ids are those of byte_bpe_50k.json, whose vocabulary it is."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
    return _encoders[path]


def ids_of(encode, text: str) -> np.ndarray:
    """The ids of a text, which may hold white space of any length."""
    try:
        return encode.encode_to_numpy(text, allowed_special="all")
    except ValueError:  # too long a run for the matcher
        out = []
        for i, part in enumerate(text.split(END_OF_TEXT)):
            if i:
                out.append([END_OF_TEXT_ID])
            at = 0
            for run in LONG_SPACE.finditer(part):
                end = run.end() - (run.end() < len(part))
                out += [encode.encode_ordinary(part[at : run.start()]), encode._encode_single_piece(part[run.start() : end])]
                at = end
            out.append(encode.encode_ordinary(part[at:]))
        return np.concatenate([np.array(x, np.uint32) for x in out])


class RoomTree:
    """A segment tree over remaining capacities 0 to capacity: which of them open sequences have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)

    def mark(self, room: int, some: bool) -> None:
        at = room + self.size
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least`."""
        at = least + self.size
        while not self.some[at]:
            while at & 1:  # a right child: what follows is not under its parent
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length its ranges, in the order of ranks: (first rank, first sequence, pieces a sequence, offset of the first)."""
    tree, open_groups = RoomTree(capacity), {}
    out, sequences = {}, 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_groups.setdefault(room, []).append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank, ranges = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_groups[room].pop()
                if not open_groups[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            for used, pieces in ((full, each), (int(full < n and 0 < left - full * each < each), left - full * each)):
                if used:
                    ranges.append((rank, first, pieces, capacity - room))
                    rank, left = rank + used * pieces, left - used * pieces
                    put(room - pieces * length, first, used)
                    first, n = first + used, n - used
            put(room, first, n)
        out[length] = np.array(ranges, np.int64)
    return out


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's place: part, and rank among the part's pieces of its length."""

    def cut(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            cols: dict[str, list] = {x: [] for x in ("row", "piece", "start", "length", "crc", "rank", "ids")}
            for row, text in enumerate(batch.column("text")):
                ids = np.append(ids_of(encode, text.as_py() or ""), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)) if len(ids) > capacity else ((0, len(ids)),):
                    start = max(0, end - capacity) if len(ids) > capacity else 0
                    own = ids[start:end]
                    for name, value in (("row", row), ("piece", piece), ("start", start), ("length", end - start), ("crc", zlib.crc32(own)), ("rank", seen[end - start])):
                        cols[name].append(value)
                    if keep_ids:
                        cols["ids"].append(own.astype(np.int32))
                    seen[end - start] += 1
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(cols["row"], pa.int64())),
                "piece": pa.array(cols["piece"], pa.int32()),
                "start": pa.array(cols["start"], pa.int64()),
                "length": pa.array(cols["length"], pa.int64()),
                "ids_crc32": pa.array(cols["crc"], pa.int64()),
                "part": pa.array([part] * len(cols["row"]), pa.int32()),
                "rank": pa.array(cols["rank"], pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array(cols["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every document."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, end_id, vocabulary or vocabulary_path(), keep_ids), "pieces")
    held = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    ranges = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")

    def place(batch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for size in np.unique(length):
            mine = length == size
            own = ranges.value[int(size)]
            first, begin, each, at = own[np.searchsorted(own[:, 0], rank[mine], "right") - 1].T
            step = rank[mine] - first
            sequence[mine], offset[mine] = begin + step // each, at + step % each * size
        kept = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)} | ({"ids": batch.column("ids")} if keep_ids else {}))

    return in_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)
