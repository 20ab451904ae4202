"""Older forms of the archive as sources: folders of exports, compressed segments, single-file archives, and logs of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.columns import trimmed
from chatloom.operators.archive import Archive

# What is scanned, and what a segment's header says.
ENDINGS = (".json", ".csv", ".txt")
MOST_FILES, MOST_BYTES, MOST_DEPTH = 20_000, 512 * 1024 * 1024, 24
KINDS = ("snapshot", "delta")
TASK_LOG = "-task-extraction-"


def scanned(files: DataFrame, root: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The files (path, length, modified) below a folder that an import takes, the newest first, at most so many; and one row that
    tells whether these are all: complete, truncated, oversized, too_deep. The limit is the scan's own, and what it leaves out is told."""
    below = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 30))
    rows = files.withColumn("below", below).withColumn("depth", F.size(F.split("below", "/")) - 1)
    rows = rows.where(F.lower("path").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"))
    fits = (F.col("length") <= most_bytes) & (F.col("depth") <= most_depth)
    taken = rows.where(fits).orderBy(F.desc("modified"), "path").limit(most_files)
    told = rows.agg((F.count_if(fits) > most_files).alias("truncated"), F.count_if(F.col("length") > most_bytes).alias("oversized"), F.coalesce(F.max("depth") > most_depth, F.lit(False)).alias("too_deep"))
    told = told.select((~F.col("truncated") & (F.col("oversized") == 0) & ~F.col("too_deep")).alias("complete"), "*")
    signature = F.concat_ws(":", "below", F.col("length").cast("string"), F.unix_millis(F.col("modified").cast("timestamp")).cast("string"))
    return taken.select("path", signature.alias("signature"), "length", "modified"), told


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of all files below a folder; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), "length", F.col("modificationTime").alias("modified"))


def segment_operations(spark: SparkSession, path: str, item_schema: str, checksums: DataFrame | None = None) -> DataFrame:
    """file, seq, line, kind, op, id, item of compressed segments: a header of JSON, then an operation a line. The number that a file's
    name begins with orders segments, the line the operations of one. With checksums (file, sha256), a file whose bytes have
    another one or that is not listed is an error; so is a line that is no operation, and a header without a schema."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    # a segment is compressed, so it is one split and its lines are numbered in one task in their order
    lines = spark.read.text(path, wholetext=False).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value", F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    parsed = lines.withColumn("v", F.from_json("value", f"schema string, kind string, op string, id string, item {item_schema}"))
    parsed = parsed.withColumn("is_header", F.col("v.schema").isNotNull())
    bad = F.col("v.op").isNull() | ~F.col("v.op").isin("upsert", "delete")
    ops = parsed.where("NOT is_header").withColumn("op", F.when(bad, F.raise_error(F.concat(F.lit("no operation: "), "file", F.lit(" "), F.substring("value", 1, 80)))).otherwise(F.col("v.op")))
    kinds = parsed.where("is_header").groupBy("file").agg(F.first("v.kind").alias("kind"))
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no header: "), "file")))
    out = ops.join(kinds, "file", "left").withColumn("kind", known)
    if checksums is not None:
        held = spark.read.format("binaryFile").load(path).select(name.alias("file"), F.sha2("content", 256).alias("is"))
        wrong = held.join(checksums, "file", "left").where(~F.col("is").eqNullSafe(F.col("sha256"))).select("file", F.lit(True).alias("wrong"))
        out = out.join(wrong, "file", "left").withColumn("op", F.when(F.col("wrong"), F.raise_error(F.concat(F.lit("checksum of "), "file"))).otherwise(F.col("op")))
    seq = F.regexp_extract("file", r"^(\d+)-", 1).cast("long")
    return out.select("file", seq.alias("seq"), "line", "kind", "op", F.coalesce("v.id", "v.item.id").alias("id"), F.col("v.item").alias("item"))


def state_of(operations: DataFrame) -> DataFrame:
    """The rows that are there after all operations: the last snapshot and what follows it, the last operation of each id, also of
    several in one segment."""
    start = operations.where("kind = 'snapshot'").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    last = operations.where(F.col("seq") >= start).groupBy("id").agg(F.max_by(F.struct("op", "item"), F.struct("seq", "line")).alias("last"))
    return last.where("last.op = 'upsert'").select("id", "last.item")


def legacy_rows(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """The rows of a single-file archive, compressed or not: a list of rows, or an object that has them as `items`."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{item_schema}>")
    held = F.from_json("value", f"items array<{item_schema}>")["items"]
    return text.select(F.explode(F.when(trimmed("value").startswith("["), listed).otherwise(held)).alias("item")).select("item.*")


def replayed(logs: DataFrame) -> DataFrame:
    """Messages out of logs of work (started_at, conversation_id, conversation_name, records): overlaps have a message several times, and the newest stays."""
    rows = logs.select("started_at", "conversation_id", "conversation_name", F.explode("records").alias("r"))
    last = rows.groupBy("r.id").agg(F.max_by(F.struct("started_at", "conversation_id", "conversation_name", "r"), F.struct("started_at", "r")).alias("x"))
    return last.select("id", "x.conversation_id", "x.conversation_name", F.col("x.started_at").alias("ai_analyzed_at"), *[F.col(f"x.r.{f.name}").alias(f.name) for f in logs.schema["records"].dataType.elementType if f.name != "id"])


def recovered(archive: Archive, rows: DataFrame) -> bool:
    """Commit recovered rows, unless the archive holds more than they are."""
    state = archive.snapshot()
    if state is not None and state.count() > rows.count():
        return False
    archive.commit(rows)
    return True
