"""A versioned archive of rows: an append-only log of upserts and deletes in Parquet, and what follows from it.

A version is one directory of the log; a snapshot version starts over. `current` and `changes` are aggregations by id
with partial maxima, so a key that is written often costs no more than its rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPACT_SEGMENTS, COMPACT_LEAST, DELTA_SHARE = 24, 10_000, 0.75
#: How many rows an operation adds (-1 to 1): a column of operations on their way into a segment.
ADDS = "_adds"


def latest(ops: DataFrame, *order: str) -> DataFrame:
    """The last operation of each id, by the order columns."""
    others = [c for c in ops.columns if c != "id"]
    last = ops.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select("id", *[F.col(f"last.{c}").alias(c) for c in others])


def current(ops: DataFrame, *order: str) -> DataFrame:
    """The rows that are there after all operations."""
    return latest(ops, *order).where("op = 'upsert'")


def changes(ops: DataFrame, since: int, *order: str) -> DataFrame:
    """The net upserts and deletes after a version."""
    return latest(ops.where(F.col(order[0]) > since), *order)


def digest(df: DataFrame, *leave: str):
    """A hash of all columns but the id and those left out, nulls told apart from blanks."""
    return F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("id", *leave)]), {"ignoreNullFields": "false"}), 256)


def difference(old: DataFrame, new: DataFrame, *leave: str) -> DataFrame:
    """id, op: what makes new of old."""
    a = old.select("id", digest(old, *leave).alias("was"))
    b = new.select("id", digest(new, *leave).alias("is"))
    op = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("is")), "upsert")
    return a.join(b, "id", "full").select("id", op.alias("op")).where("op IS NOT NULL")


def effective(state: DataFrame, upserts: DataFrame, delete_ids: DataFrame, *leave: str) -> DataFrame:
    """id, op of the operations that change anything: an upsert beats a delete of its id, equal rows are dropped, and so are
    deletes of what is not there."""
    return effective_rows(state, upserts, delete_ids, *leave).select("id", "op")


def effective_rows(state: DataFrame, upserts: DataFrame, delete_ids: DataFrame, *leave: str) -> DataFrame:
    """The operations of `effective` with the columns of the upserts' rows, and ADDS."""
    has = state.select("id", digest(state, *leave).alias("was"))
    each = upserts.select("id", digest(upserts, *leave).alias("is"), F.struct(*upserts.columns).alias("row"))
    ups = each.join(has, "id", "left").where("was IS NULL OR was <> is").select("row.*", F.lit("upsert").alias("op"), F.col("was").isNull().cast("int").alias(ADDS))
    downs = delete_ids.select("id").distinct().join(upserts.select("id"), "id", "left_anti").join(has.select("id"), "id", "left_semi")
    return ups.unionByName(downs.withColumns({"op": F.lit("delete"), ADDS: F.lit(-1)}), allowMissingColumns=True)


def first_only(rows: DataFrame, column: str, by: list[str], order: list) -> DataFrame:
    """The column stays on the first row of its group and is null on the others."""
    nth = F.row_number().over(Window.partitionBy(*by, column).orderBy(*order))
    return rows.withColumn(column, F.when(nth == 1, F.col(column)))


def reconciled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both sides by id; where both have one, the local row."""
    return local.unionByName(remote.join(local.select("id"), "id", "left_anti"))


def upsert_counts(old: DataFrame, new: DataFrame, *leave: str) -> DataFrame:
    """One row: how many of the new rows are added, updated or duplicates."""
    both = new.select("id", digest(new, *leave).alias("is")).join(old.select("id", digest(old, *leave).alias("was")), "id", "left")
    return both.agg(
        F.count_if(F.col("was").isNull()).alias("added"),
        F.count_if(F.col("was") != F.col("is")).alias("updated"),
        F.count_if(F.col("was") == F.col("is")).alias("duplicate"),
    )


class Conflict(Exception):
    """Somebody else has committed since the version that a commit expects."""


@dataclass
class Archive:
    """Commits and reads of one archive.

    A version is a manifest, `manifests/<version>.json`, that names the segments it consists of; the highest is the archive's
    state. Rows are written to a folder of their own first, the manifest to a temporary file, which is then renamed to a
    name that must be free: a writer that stops half-way leaves files that nothing names, and of two writers that start from
    one version the second fails and changes nothing."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _manifests(self) -> list[str]:
        """The manifests' names, the oldest first."""
        fs, place = self._fs(f"{self.path}/manifests")
        return sorted(f.getPath().getName() for f in fs.listStatus(place) if f.getPath().getName().endswith(".json")) if fs.exists(place) else []

    def manifest(self) -> list[dict]:
        """The segments in their order: version, kind, rows, digest, folder, and (of those written with them) schema and held, how many rows there are then."""
        names = self._manifests()
        if not names:
            return []
        fs, place = self._fs(f"{self.path}/manifests/{names[-1]}")
        file = fs.open(place)
        try:
            lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8").splitlines()
        finally:
            file.close()
        return sorted((json.loads(line) for line in lines if line), key=lambda s: s["version"])

    def _publish(self, segments: list[dict]) -> None:
        """Make this the version of its last segment, unless there is one of that number."""
        version = segments[-1]["version"]
        fs, temporary = self._fs(f"{self.path}/unpublished/{version}-{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray("\n".join(map(json.dumps, segments)).encode()))
        out.close()
        sc, (_, final) = self.spark.sparkContext, self._fs(f"{self.path}/manifests/{version:012d}.json")
        fs.mkdirs(final.getParent())
        hadoop = sc._jvm.org.apache.hadoop.fs
        free_name_only = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(final.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(final), free_name_only)
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise Conflict(f"version {version} has been written by somebody else") from error
            raise

    def version(self) -> int:
        return max([s["version"] for s in self.manifest()], default=0)

    def _read(self, segment: dict) -> DataFrame:
        """A segment's operations. Its manifest knows their columns, so no file is opened to find them."""
        reader = self.spark.read.schema(StructType.fromJson(segment["schema"])) if "schema" in segment else self.spark.read
        return reader.parquet(f"{self.path}/{segment['folder']}")

    def ops(self) -> DataFrame | None:
        """All operations since the last snapshot, with their version."""
        return self._ops(self.manifest())

    def _ops(self, segments: list[dict]) -> DataFrame | None:
        start = max([i for i, s in enumerate(segments) if s["kind"] == "snapshot"], default=0)
        out = None
        for s in segments[start:]:
            part = self._read(s).withColumn("version", F.lit(s["version"]))
            out = part if out is None else out.unionByName(part)
        return out

    def _keys(self, segments: list[dict]) -> DataFrame:
        """id, op, version of all operations since the last snapshot: one scan of all segments if each knows its columns."""
        since = segments[max([i for i, s in enumerate(segments) if s["kind"] == "snapshot"], default=0) :]
        types = [{f["name"]: f for f in s["schema"]["fields"]} if "schema" in s else None for s in since]
        if None in types or any(t["id"]["type"] != types[0]["id"]["type"] for t in types):
            return self._ops(segments).select("id", "op", "version")
        rows = self.spark.read.schema(StructType.fromJson({"type": "struct", "fields": [types[0]["id"], types[0]["op"]]})).parquet(*[f"{self.path}/{s['folder']}" for s in since])
        return rows.select("id", "op", F.regexp_extract("_metadata.file_path", r"/v=(\d+)-[^/]*/[^/]*$", 1).cast("int").alias("version"))

    def snapshot(self) -> DataFrame | None:
        segments = self.manifest()
        if segments and segments[-1]["kind"] == "snapshot":  # one row an id, nothing to aggregate
            return self._read(segments[-1]).drop("op")
        ops = self._ops(segments)
        return None if ops is None else current(ops, "version").drop("op", "version")

    def _count(self, segments: list[dict]) -> int:
        """How many rows there are; of the segments, only ids are read."""
        return current(self._keys(segments), "version").count()

    def _named(self, segments: list[dict], ids: DataFrame) -> DataFrame:
        """The rows that there are of these ids. Beyond their ids, only segments are read that hold the last operation on one of them."""
        last = self._keys(segments).join(ids, "id", "left_semi").groupBy("id").agg(F.max("version").alias("version"))
        held = {r["version"] for r in last.select("version").distinct().collect()}  # a row a segment
        rows = self._ops([s for s in segments if s["version"] in held]) if held else self._ops(segments[-1:]).where(F.lit(False))
        return current(rows.join(ids, "id", "left_semi"), "version").drop("op", "version")

    def _written(self, ops: DataFrame, kind: str, version: int, told: dict | None = None, before: int | None = None) -> dict:
        """A segment's rows in a folder of their own; counts and digest are taken while they are written. before: how many rows the archive holds."""
        folder, seen, rows = f"v={version}-{uuid.uuid4().hex[:12]}", Observation(), ops.drop(ADDS)
        adds = [F.coalesce(F.sum(ADDS), F.lit(0)).alias("adds")] if ADDS in ops.columns else []
        ops.observe(seen, *_counted(rows), *adds).drop(ADDS).write.parquet(f"{self.path}/{folder}")
        held = seen.get["rows"] if kind == "snapshot" else before + seen.get["adds"] if before is not None and adds else None
        return {"version": version, "kind": kind, "rows": seen.get["rows"], "digest": seen.get["digest"], "folder": folder, "schema": rows.schema.jsonValue()} | ({} if held is None else {"held": held}) | (told or {})

    def _append(self, ops: DataFrame, segments: list[dict], told: dict | None = None) -> int:
        now = max([s["version"] for s in segments], default=0)
        new = self._written(ops, "delta" if segments else "snapshot", now + 1, told, segments[-1].get("held") if segments else None)
        if new["rows"] == 0 and segments and not told:
            self._gone(new["folder"])
            return now
        try:
            self._publish([*segments, new])
        except Conflict:
            self._gone(new["folder"])
            raise
        if len(segments) + 1 >= COMPACT_SEGMENTS or (segments and new["rows"] >= COMPACT_LEAST and new["rows"] >= (new["held"] if "held" in new else self._count([*segments, new]))):
            return self.compact()
        return now + 1

    def _gone(self, folder: str) -> None:
        fs, place = self._fs(f"{self.path}/{folder}")
        fs.delete(place, True)

    def _expecting(self, expected: int | None) -> list[dict]:
        segments = self.manifest()
        now = max([s["version"] for s in segments], default=0)
        if expected is not None and expected != now:
            raise Conflict(f"the archive is at version {now}, not {expected}")
        return segments

    def commit(self, rows: DataFrame, expected: int | None = None, told: dict | None = None) -> int:
        """Make the archive hold exactly these rows (one an id). What is told of the version stands in its manifest."""
        segments, state = self._expecting(expected), self.snapshot()
        if state is None:
            return self._append(rows.withColumn("op", F.lit("upsert")), segments, told)
        return self._append(_filled(difference(state, rows), rows), segments, told)

    def commit_delta(self, upserts: DataFrame, delete_ids: DataFrame, expected: int | None = None) -> int:
        """Add, replace and delete rows; what changes nothing is left out. It costs what the delta is, and a look at the archive's ids."""
        segments = self._expecting(expected)
        if not segments:
            return self._append(upserts.withColumn("op", F.lit("upsert")), segments)
        state = self._named(segments, upserts.select("id").unionAll(delete_ids.select("id")))
        return self._append(effective_rows(state, upserts, delete_ids), segments)

    def told(self) -> dict:
        """The fingerprint of the source that the last snapshot of a source came from, and when, if one was told."""
        return next(({k: s[k] for k in ("fingerprint", "updated_at")} for s in reversed(self.manifest()) if "fingerprint" in s), {"fingerprint": None, "updated_at": None})

    def saved(self, local: DataFrame, seen: int, fingerprint: str | None, imported_at: str | None, tries: int = 5) -> tuple[int, str]:
        """Save a window's rows, which it has made from version `seen`, and the side that stands: local, remote or both.

        If somebody else has committed since, the archive is read again and decided by the sources' fingerprints: if they differ, the
        newer snapshot stands whole (without times, the archive's), as merging would bring back what its source has dropped; if
        they agree, both by id, where both have one the local row. That is tried on the version just read, and again if that has
        been overtaken."""
        rows, side, told = local, "local", {"fingerprint": fingerprint, "updated_at": imported_at}
        for _ in range(tries):
            try:
                return self.commit(rows, expected=seen, told=told if side != "remote" else None), side
            except Conflict:
                seen, remote = self.version(), self.told()
                if remote["fingerprint"] != fingerprint:
                    newer = fingerprint is not None and imported_at is not None and (remote["updated_at"] is None or imported_at > remote["updated_at"])
                    if not newer:
                        return seen, "remote"
                    rows, side = local, "local"
                else:
                    rows, side = reconciled(local, self.snapshot()), "both"
        raise Conflict(f"overtaken {tries} times")

    def changes(self, since: int, limit: int = 20_000) -> DataFrame | None:
        """The net operations after a version; None if a snapshot lies between or they are too many: reload then."""
        segments = self.manifest()
        if since > self.version() or any(s["kind"] == "snapshot" and s["version"] > since for s in segments):
            return None
        ops = self.ops()
        if ops is None:
            return None
        found = changes(ops, since, "version")
        return None if found.limit(limit + 1).count() > limit else found

    def compact(self) -> int:
        """One snapshot in the place of all segments; when it is published, the old ones and their manifests are deleted."""
        segments, names = self.manifest(), self._manifests()
        now = max(s["version"] for s in segments)
        self._publish([self._written(self.snapshot().withColumn("op", F.lit("upsert")), "snapshot", now + 1)])
        for old in [*(f"manifests/{n}" for n in names), *(s["folder"] for s in segments)]:
            fs, place = self._fs(f"{self.path}/{old}")
            fs.delete(place, True)
        return now + 1

    def migrate(self, legacy: DataFrame) -> int:
        """The first version of an archive from the rows of a single file; nothing if there is an archive already."""
        if self.manifest():
            return self.version()
        segment = self._written(legacy.withColumn("op", F.lit("upsert")), "snapshot", 1)
        self._publish([segment])
        return 1

    def verify(self) -> list[int]:
        """The versions whose rows are not those that were written."""
        return [s["version"] for s in self.manifest() if segment_digest(self._read(s)).first().asDict() != {"rows": s["rows"], "digest": s["digest"]}]


def segment_digest(ops: DataFrame) -> DataFrame:
    """rows and a digest that does not hang on their order: the sum of the rows' hashes."""
    return ops.agg(*_counted(ops))


def _counted(ops: DataFrame) -> list[Column]:
    each = F.xxhash64(F.to_json(F.struct(*sorted(ops.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest")]


def _filled(ops: DataFrame, rows: DataFrame) -> DataFrame:
    """The operations with the columns of their rows."""
    return ops.join(rows, "id", "left").select("id", *[c for c in rows.columns if c != "id"], "op")


def delta_or_snapshot(changed: int, rows: int, has_base: bool) -> str:
    """How to save: a delta if a base is known and less than three quarters change."""
    if has_base and changed == 0:
        return "nothing"
    return "delta" if has_base and changed < DELTA_SHARE * rows else "snapshot"
