"""What the training-data operators share: staged tables and word-level views of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.sources.staging import new_path, shared_dir, staged

__all__ = ["new_path", "shared_dir", "staged"]

#: Text bytes that are looked at together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """A-Z to a-z and nothing else. Texts of ASCII only take the fast way."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def with_row_key(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id, text and the hash of the text, which tells apart rows that share an id; other columns are left out."""
    return docs.select("doc_id", "text", *names, F.xxhash64("text").alias("row_key"))


def bucketed(df: DataFrame, path: str, keys: list[str], **options: str) -> DataFrame:
    """Write df to path in buckets of its keys, sorted, and read it again; joins by the keys need not shuffle it."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).options(**options).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved; the name is of no more use, the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


# Word-level views ---------------------------------------------------------------------------------------------------


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As large_binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary()).fill_null(b"")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) for runs of rows of about limit bytes."""
    texts = binary(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_table(*separators: tuple[int, int]) -> np.ndarray:
    """True for bytes that belong to words: all but those of the given closed ranges."""
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words are runs of anything but space and the five control characters from tab to carriage return.
SPACED = word_table((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; none goes over the end of a row."""
    inside = table[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: A-Z to a-z for UTF-8 bytes.
_FALL = np.arange(256, dtype=np.uint8)
_FALL[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _FALL[data]


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins: consecutive words are then a slice."""
    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = np.full(place[-1], 0x20, np.uint8)
    inside = np.ones(place[-1], bool)
    inside[place[1:] - 1] = False
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    out[inside] = data[np.cumsum(mask[:-1]).astype(bool)]
    return out.tobytes(), place


# Rolling polynomial hashes modulo 2^64 --------------------------------------------------------------------------------

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for name, base in (("up", _RADIX), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread (a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, over row ends as well."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    if len(values) < w:
        return values[:0]
    span, out = 1, values
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(values) - w + 1], out[w - span :])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, rising. numpy's own goes by hashes when it need not count, many times slower for large arrays."""
    values = np.sort(values)
    return values[_heads(values)]


def distinct_inverse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, rising, a place of each, and for every value the number of its own."""
    order = np.argsort(values)
    ordered = values[order]
    heads = _heads(ordered)
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(heads) - 1
    return ordered[heads], order[heads], which


def _heads(ordered: np.ndarray) -> np.ndarray:
    heads = np.ones(len(ordered), bool)
    heads[1:] = ordered[1:] != ordered[:-1]
    return heads


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow for a function from one RecordBatch to an iterator of RecordBatches or tables."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)
