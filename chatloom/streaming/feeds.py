"""Streams that follow an archive and a folder of device snapshots, as sources of Structured Streaming, and what consumes them.

    spark.dataSource.register(ArchiveChanges)
    follow(spark.readStream.format("archive_changes").option("path", folder).load(), target, checkpoint)

A source's offsets are all that a restart needs: of an archive the version, of a folder the size and time of each file that
was ready. Both list through pyarrow's file systems, so a path may be local or a URI that those know."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from chatloom.operators.archive import Archive, current, digest, latest, upsert_counts
from chatloom.sources.inbox import SNAPSHOT, Envelope, device_events

#: Rows of a segment's file that are handed on together.
BATCH_ROWS = 10_000
#: Files, and bytes of them, that a task reads.
BUNDLE_FILES, BUNDLE_BYTES = 16, 2 << 20
SETTLE_MS, MOST_BYTES, MOST_FILES = 4000, 4 << 20, 10_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# An archive's changes -----------------------------------------------------------------------------------------------


def _manifests(path: str) -> list[int]:
    """The versions that have a manifest."""
    fs, base = _place(path)
    found = fs.get_file_info(pafs.FileSelector(f"{base}/manifests", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def _segments(path: str, version: int) -> list[dict]:
    fs, base = _place(path)
    with fs.open_input_stream(f"{base}/manifests/{version:012d}.json") as file:
        return sorted((json.loads(line) for line in file.read().decode().splitlines() if line), key=lambda s: s["version"])


class SegmentFile(InputPartition):
    """A file of a segment, or (without one) the mark that what follows starts over."""

    def __init__(self, file: str | None, version: int, reset: bool):
        super().__init__(None)
        self.file, self.version, self.reset = file, version, reset


class ArchiveChanges(DataSource):
    """The operations of an archive (`path`) as a stream: its columns with op, version and reset.

    An offset is a version. A batch from one version to another is the segments between, a file a partition. If a snapshot lies
    between, or the versions asked for have been compacted away, or nothing has been read yet, the batch starts over: it is
    the last snapshot and what follows it, all rows say `reset`, and one row more, whose op is `reset`, says so even if no row is left."""

    @classmethod
    def name(cls) -> str:
        return "archive_changes"

    def schema(self) -> StructType:
        path = self.options["path"]
        versions = _manifests(path)
        if not versions:
            raise ValueError("the archive has no version yet, so no columns are known; give a schema or wait")
        fs, base = _place(path)
        folder = _segments(path, versions[-1])[-1]["folder"]
        file = next(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}")) if f.base_name.endswith(".parquet"))
        own = from_arrow_schema(pq.read_schema(file, filesystem=fs), prefer_timestamp_ntz=True)
        return StructType([*(StructField(f.name, f.dataType) for f in own), StructField("version", LongType()), StructField("reset", BooleanType())])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 (the name is Spark's)
        return ArchiveReader(self.options["path"], schema)


class ArchiveReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(_manifests(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, to = start["version"], end["version"]
        versions = _manifests(self.path)
        if since == to or not versions:
            return []
        known = next(v for v in versions if v >= to)  # later than asked for, if that has been compacted away
        segments = _segments(self.path, known)
        if known > to:
            segments = [s for s in segments if s["version"] <= to] or segments
        snapshots = [i for i, s in enumerate(segments) if s["kind"] == "snapshot" and s["version"] > since]
        reset = since == 0 or bool(snapshots) or segments[0]["version"] > since + 1
        chosen = segments[snapshots[-1] if snapshots else 0 :] if reset else [s for s in segments if s["version"] > since]
        fs, base = _place(self.path)
        out = [SegmentFile(f.path, s["version"], reset) for s in chosen for f in fs.get_file_info(pafs.FileSelector(f"{base}/{s['folder']}")) if f.base_name.endswith(".parquet")]
        return [SegmentFile(None, to, True), *out] if reset else out

    def read(self, partition: SegmentFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if partition.file is None:
            row = {"op": "reset", "version": partition.version, "reset": True}
            yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in schema}], schema=schema)
            return
        fs, _ = _place(self.path)
        with fs.open_input_file(partition.file) as file:
            for batch in pq.ParquetFile(file).iter_batches(BATCH_ROWS):
                told = {"version": pa.array([partition.version] * batch.num_rows, pa.int64()), "reset": pa.array([partition.reset] * batch.num_rows)}
                columns = [told[f.name] if f.name in told else batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def commit(self, end: dict) -> None:
        pass


def applied(batch: DataFrame, target: Archive) -> int:
    """The target after a batch of archive_changes: replaced if the batch starts over, else changed. The same batch again changes nothing."""
    ops = batch.where("op <> 'reset'").drop("reset")
    if not batch.where("op = 'reset'").isEmpty():
        return target.commit(current(ops, "version").drop("op", "version"))
    net = latest(ops, "version")
    return target.commit_delta(net.where("op = 'upsert'").drop("op", "version"), net.where("op = 'delete'").select("id"))


def follow(changes: DataFrame, target: Archive, checkpoint: str) -> StreamingQuery:
    """Keep the target archive like the one whose changes are streamed, up to now. A consumer that stops goes on from its offset."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            applied(batch, target)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Device snapshots ---------------------------------------------------------------------------------------------------


def listed(path: str, folders: str, file: str, settle_ms: int, most_bytes: int, most: int, now_ms: float | None = None) -> tuple[dict[str, list[int]], int]:
    """size and time of the files that are ready, by their path below the folder, and how many are pending: written within
    settle_ms, or of more than most_bytes. Of the files whose names and folders' names match, sorted, the first `most` are looked at."""
    fs, base = _place(path)
    base = base.rstrip("/")
    now = time.time() * 1000 if now_ms is None else now_ms
    inner = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory and re.fullmatch(folders, f.base_name)]
    files = [f for d in inner for f in fs.get_file_info(pafs.FileSelector(d.path)) if f.type == pafs.FileType.File and re.fullmatch(file, f.base_name)]
    at = {"/".join(f.path.split("/")[-2:]): [f.size, f.mtime_ns // 1_000_000] for f in sorted(files, key=lambda f: f.path)[:most]}
    ready = {p: x for p, x in at.items() if x[0] <= most_bytes and now - x[1] >= settle_ms}
    return ready, len(at) - len(ready)


class SnapshotBundle(InputPartition):
    """Files (path, size, time) that one task reads one after another."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class SnapshotFiles(DataSource):
    """The snapshot files of a folder (`path`) as they become ready, also when one is written again: source_file, size, mtime_ms, value.

    Options: folders and file (patterns of names), settleMs, mostBytes, mostFiles. An offset is what `listed` finds, so a file
    that is pending is in no offset and comes with a later one; a batch is the files whose size or time differs between two."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_files"

    def schema(self) -> str:
        return "source_file string, size long, mtime_ms long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return SnapshotReader(dict(self.options))


class SnapshotReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        lower = {k.lower(): v for k, v in options.items()}
        self.path = lower["path"].rstrip("/")
        self.asked = (lower.get("folders", ".*"), lower["file"], int(lower.get("settlems", SETTLE_MS)), int(lower.get("mostbytes", MOST_BYTES)), int(lower.get("mostfiles", MOST_FILES)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": listed(self.path, *self.asked)[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        bundles: list[list[tuple[str, int, int]]] = [[]]
        room = BUNDLE_BYTES
        for path, (size, mtime) in sorted(end["files"].items()):
            if start["files"].get(path) == [size, mtime]:
                continue
            if bundles[-1] and (len(bundles[-1]) >= BUNDLE_FILES or size > room):
                bundles.append([])
                room = BUNDLE_BYTES
            bundles[-1].append((path, size, mtime))
            room -= size
        return [SnapshotBundle(b) for b in bundles if b]

    def read(self, partition: SnapshotBundle) -> Iterator[tuple]:
        fs, base = _place(self.path)
        for path, size, mtime in partition.files:
            try:
                with fs.open_input_stream(f"{base}/{path}") as file:
                    value = file.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since; if it comes back, its time differs
                continue
            yield path, size, mtime, value

    def commit(self, end: dict) -> None:
        pass


def taken(batch: DataFrame, events: Archive, files: Archive, envelope: Envelope, producer: str, imported_at: str) -> DataFrame:
    """Take a batch of snapshot_files into the archive of events; the archive of files (id: the path; hash, size, mtime_ms, events)
    keeps what has been taken. A file of a known hash is not taken again, only its size and time noted; one that is no JSON
    is not noted, so it counts as new whenever it changes; one with another envelope is noted with no events.
    One row: files, invalid, added, updated, duplicate."""
    rows = batch.withColumn("hash", F.sha2("value", 256))
    known = files.snapshot()
    if known is not None:
        rows = rows.join(known.select(F.col("id").alias("source_file"), F.col("hash").alias("known_hash"), F.col("events").alias("known_events")), "source_file", "left")
    else:
        rows = rows.withColumns({"known_hash": F.lit(None).cast("string"), "known_events": F.lit(None).cast("long")})
    rows = rows.where(F.try_parse_json("value").isNotNull()).persist()
    fresh = rows.where(~F.col("hash").eqNullSafe(F.col("known_hash")))
    platform = F.coalesce(F.from_json("value", SNAPSHOT)["device"]["platform"], F.lit("unknown"))
    documents = fresh.select(F.concat(platform, F.lit("/"), "source_file").alias("source_file"), "value")
    made, bad = device_events(documents, envelope, producer, imported_at)
    made = made.persist()
    per_file = made.groupBy(F.expr("substring(source_file, length(platform) + 2)").alias("source_file")).agg(F.count("*").alias("n"))
    # of one id in several files of a batch, the last by file
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("source_file")))
    one = made.withColumn("nth", last).where("nth = 1").drop("nth", "platform").persist()
    try:
        state = events.snapshot()
        state = one.limit(0) if state is None else state
        leave = ("imported_at",)
        counts = (fresh.count(), bad.count(), *upsert_counts(state, one, *leave).first())
        same = one.select("id", digest(one, *leave).alias("x")).join(state.select("id", digest(state, *leave).alias("x")), ["id", "x"], "left_semi")
        events.commit_delta(one.join(same.select("id"), "id", "left_anti"), one.select("id").limit(0))
        noted = rows.join(per_file, "source_file", "left").select(F.col("source_file").alias("id"), "hash", "size", "mtime_ms", F.when(F.col("hash").eqNullSafe(F.col("known_hash")), F.col("known_events")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("events"))
        files.commit_delta(noted, noted.select("id").limit(0))
    finally:
        for held in (one, made, rows):
            held.unpersist()
    return batch.sparkSession.createDataFrame([counts], "files long, invalid long, added long, updated long, duplicate long")


def device_ingest(snapshots: DataFrame, events: Archive, files: Archive, envelope: Envelope, producer: str, imported_at: str, log: str, checkpoint: str) -> StreamingQuery | None:
    """Run all snapshots that are ready into the archive of events, with the counts of each batch in the folder `log`. None as
    long as that archive has no version: nothing is read then, so what is there waits. A batch that is run again after a
    failure finds the hashes noted, or the events there, and adds nothing."""
    if events.version() == 0:
        return None

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            taken(batch, events, files, envelope, producer, imported_at).write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            batch.unpersist()

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
