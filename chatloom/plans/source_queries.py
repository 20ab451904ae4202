"""Queries over sources: the driver's tables are laid out as files of each kind and read back by its source; and over streams that
follow them. What is read back is what was laid out, so their SQL is over the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import conversation_kind
from chatloom.operators import archive, evidence, merge, persons
from chatloom.plans.queries import joined, keyed, query
from chatloom.plans.workflow_queries import _cards
from chatloom.sources import adapted, files, history, inbox, layouts
from chatloom.sources.staging import new_path
from chatloom.streaming import feeds, ingest

ENVELOPE = inbox.Envelope("chat/v1", "PRODUCER", "immutable", "m")
DEVICE = inbox.Envelope("device/v1", "PRODUCER", "immutable")
IMPORTED = "2024-02-01T00:00:00.000Z"


def _exported(spark, sf_dir) -> DataFrame:
    """Messages as an export has them: whole seconds, someone who speaks. Ten conversations make one of the export's."""
    conv, turn = (F.split("id", "-")[i].cast("long") for i in (1, 2))
    ten = F.floor(conv / 10)
    return adapted.message(spark, sf_dir).select(
        F.when(ten % 4 == 0, "group").otherwise("direct").alias("kind"),
        F.concat(F.lit("conv"), ten.cast("string")).alias("folder"),
        (conv * 1000 + turn).alias("ord"),
        F.unix_timestamp(F.col("captured_ts").cast("timestamp")).alias("at"),
        F.coalesce("speaker", F.lit("notice")).alias("speaker"),
        F.when(F.col("speaker_role") != "unknown", F.col("speaker_role") == "self").alias("own"),
        F.coalesce("content", F.lit("")).alias("text"),
    )


def _read_back(spark, parsed: DataFrame, path: str) -> DataFrame:
    """conversation, kind, speaker, role, content, captured_ts of a source's rows."""
    rows = files.messages(parsed, re.sub("^file:/*", "", path))
    return rows.select(F.regexp_replace("conversation_name", "^folder=", "").alias("conversation"), F.col("conversation_kind").alias("kind"), "speaker", F.col("speaker_role").alias("role"), "content", "captured_ts")


@query
def json_export(spark, sf_dir):
    path = layouts.trees(_exported(spark, sf_dir))
    return _read_back(spark, files.read_json(spark, path), path)


@query
def csv_export(spark, sf_dir):
    path = layouts.tables(_exported(spark, sf_dir))
    return _read_back(spark, files.read_csv(spark, path), path)


@query
def text_export(spark, sf_dir):
    path = layouts.lines(_exported(spark, sf_dir))
    return _read_back(spark, files.read_text(spark, path), path)


@query
def strict_json_export(spark, sf_dir):
    """Only objects that tell a time, a speaker or a direction count: events as bare contents have none, so none of theirs does."""
    events = adapted.table(spark, sf_dir, "events").selectExpr("user_id div 20 AS users", "CASE WHEN event_type = 'error' THEN named_struct('content', concat('event ', event_id), 'time', CAST(NULL AS STRING)) ELSE named_struct('content', concat('event ', event_id), 'time', date_format(ts, 'yyyy-MM-dd HH:mm:ss')) END AS e")
    path = new_path(spark, "strict-json")
    events.groupBy("users").agg(F.collect_list("e").alias("rows")).repartition("users").write.partitionBy("users").json(path)
    return files.messages(files.read_json(spark, path, strict=True)).select("content", "captured_ts")


@query
def segment_replay(spark, sf_dir):
    """The operation log as compressed segments, replayed."""
    ops = adapted.op_log(spark, sf_dir).select("seq", "ord", "op", "id", F.struct("id", F.col("value").cast("string").alias("value")).alias("item"))
    path = layouts.segments(ops, "ops/v1")
    state = history.state_of(history.segment_operations(spark, path, "struct<id string, value string>"))
    return state.select("id", F.col("item.value").cast("double").alias("value"))


@query
def single_file_archives(spark, sf_dir):
    """Messages as single-file archives, one for each twenty conversations: every other one a list, the rest an object that has items."""
    item = F.struct("id", "content", "status")
    rows = adapted.message(spark, sf_dir).withColumn("conv", F.floor(F.split("id", "-")[1].cast("long") / 20))
    base = new_path(spark, "archives")
    out = None
    for name, wanted in (("listed", "conv % 2 = 0"), ("held", "conv % 2 = 1")):
        each = rows.where(wanted).groupBy("conv").agg(F.collect_list(item).alias("items"))
        value = F.to_json("items") if name == "listed" else F.to_json(F.struct("items"))
        each.repartition("conv").select("conv", value.alias("value")).write.partitionBy("conv").option("compression", "gzip").text(f"{base}/{name}")
        part = history.legacy_rows(spark, f"{base}/{name}", "struct<id string, content string, status string>")
        out = part if out is None else out.unionByName(part)
    return out.select("id", "content", "status")


@query
def work_logs(spark, sf_dir):
    """Logs of work with overlaps: each message is in the log of its own and of the turn before; the newest log of a message stays."""
    rows = adapted.message(spark, sf_dir).selectExpr("*", "CAST(split(id, '-')[1] AS BIGINT) AS conv", "CAST(split(id, '-')[2] AS BIGINT) AS turn")
    each = rows.selectExpr("conv", "conversation_name", "explode(array(turn, greatest(turn - 1, 0))) AS log", "named_struct('id', id, 'content', content) AS r").distinct()
    path = new_path(spark, "work-logs")
    started = "date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(log AS INT), 0, 0), 'yyyy-MM-dd HH:mm:ss') AS started_at"
    logs = each.groupBy("conv", "conversation_name", "log").agg(F.collect_list("r").alias("records"))
    logs.selectExpr(started, "concat('conv-', conv) AS conversation_id", "conversation_name", "records").write.json(path)
    read = spark.read.schema("started_at string, conversation_id string, conversation_name string, records array<struct<id string, content string>>").json(path)
    return history.replayed(read).select("id", "conversation_id", F.col("ai_analyzed_at").alias("analyzed_at"), "content")


def _chat_documents(spark, sf_dir) -> str:
    """A batch document for each ten conversations; every fifth row comes twice, and rows of errors ask for deletes that another row undoes."""
    rows = adapted.message(spark, sf_dir).selectExpr("*", "CAST(split(id, '-')[1] AS BIGINT) AS conv", "CAST(split(id, '-')[2] AS BIGINT) AS turn")
    twice = rows.withColumn("nth", F.explode(F.when(F.col("turn") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    twice = twice.withColumn("batch", F.floor(F.col("conv") / 10))
    record = F.struct(
        F.col("conv"),
        F.col("turn"),
        F.col("nth"),
        F.concat(F.lit("m:acc:"), "conv", F.lit(":"), "turn").alias("id"),
        F.when(F.col("nth") == 0, "earlier text").otherwise(F.col("content")).alias("content"),
        F.date_format(F.coalesce("captured_ts", F.lit("2024-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capturedAt"),
        F.concat(F.lit("conv-"), "conv").alias("conversationId"),
        F.col("conversation_name").alias("conversationName"),
        F.col("conversation_kind").alias("conversationKind"),
        F.col("speaker"),
        F.col("speaker_role").alias("speakerRole"),
    )
    producer = F.struct(F.lit("PRODUCER").alias("name"), F.lit("1").alias("version"), F.lit("immutable").alias("layout"))
    deletes = F.collect_list(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("m:acc:"), "conv", F.lit(":"), (F.col("turn") + 1).cast("string"))))
    document = F.struct(F.lit("chat/v1").alias("schema"), producer.alias("producer"), F.struct(F.lit("acc").alias("id")).alias("account"), F.array_sort(F.collect_list(record)).alias("records"), deletes.alias("deleteIds"))
    return layouts.documents(twice, "batch", document, apart=False)


@query
def chat_documents(spark, sf_dir):
    """Batch documents as a batch: id, op and what an upsert carries."""
    path = _chat_documents(spark, sf_dir)
    ups, downs, _ = inbox.chat_operations(files.read_documents(spark, path, "*.txt"), ENVELOPE, "chat")
    up = ups.select("id", F.lit("upsert").alias("op"), "content", "captured_at", "speaker_role", "conversation_kind")
    return up.unionByName(downs.select("id", F.lit("delete").alias("op")), allowMissingColumns=True)


@query
def chat_stream(spark, sf_dir):
    """The same documents as a stream into an archive, in batches of files; deletes of rows that are not there change nothing."""
    held = archive.Archive(spark, new_path(spark, "archive"))
    stream = ingest.document_stream(spark, _chat_documents(spark, sf_dir), "*.txt", files_each=400)
    ingest.chat_ingest(stream, held, ENVELOPE, "chat", new_path(spark, "rejected"), new_path(spark, "point")).awaitTermination()
    return held.snapshot().select("id", "content", "captured_at", "speaker_role", "conversation_kind")


@query
def device_stream(spark, sf_dir):
    """Events as device snapshots, one for each twenty users, streamed into an archive that has the events of every third user already, with
    other titles; the archive then has them all as the snapshots tell."""
    feeds_of = adapted.context_event(spark, sf_dir)
    event = F.struct("id", F.lit("device").alias("source"), "kind", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startAt"), F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("endAt"), "title", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("values"))
    producer = F.struct(F.lit("PRODUCER").alias("name"), F.lit("1").alias("version"), F.lit("immutable").alias("layout"))
    document = F.struct(F.lit("device/v1").alias("schema"), producer.alias("producer"), F.struct(F.lit("android").alias("platform")).alias("device"), F.collect_list(event).alias("events"))
    path = layouts.documents(feeds_of.withColumn("users", F.floor(F.col("user_id") / 20)), "users", document)
    events, taken = (archive.Archive(spark, new_path(spark, n)) for n in ("events", "taken"))
    begun, _ = inbox.device_events(files.read_documents(spark, path, "*.txt").withColumn("value", F.regexp_replace("value", '"title":"', '"title":"old ')), DEVICE, "device", IMPORTED)
    events.commit(begun.where("CAST(values['user'] AS BIGINT) % 3 = 0").drop("platform"))
    spark.dataSource.register(feeds.SnapshotFiles)
    stream = spark.readStream.format("snapshot_files").option("path", layouts.local_path(spark, path)).option("folders", "of=.*").option("file", "part-.*txt").option("settleMs", 0).option("mostFiles", 1 << 30).option("mostBytes", 1 << 30).load()
    feeds.device_ingest(stream, events, taken, DEVICE, "device", IMPORTED, new_path(spark, "counts"), new_path(spark, "point")).awaitTermination()
    return events.snapshot().select("id", "kind", "title", "start_at", "end_at", F.col("values")["user"].alias("user"))


@query
def archive_follow(spark, sf_dir):
    """An archive of events that changes three times, once compacted, and another one that follows it by its change feed."""
    rows = adapted.context_event(spark, sf_dir).select("id", "kind", "start_ts", "user_id", "title")
    source, target = (archive.Archive(spark, new_path(spark, n)) for n in ("source", "target"))
    point, none = new_path(spark, "point"), rows.select("id").limit(0)
    spark.dataSource.register(feeds.ArchiveChanges)

    def follow() -> None:
        stream = spark.readStream.format("archive_changes").option("path", layouts.local_path(spark, source.path)).load()
        feeds.follow(stream, target, point).awaitTermination()

    source.commit(rows.where("user_id % 2 = 0").withColumn("title", F.lit("first")))
    follow()
    source.commit_delta(rows.where("user_id % 2 = 1"), rows.where("user_id % 10 = 0").select("id"))
    follow()
    source.commit_delta(rows.where("user_id % 4 = 0"), none)
    source.compact()
    follow()
    return target.snapshot()


@query
def people_in_increments(spark, sf_dir):
    """The people of cards that come in two parts, as merging all of them at once gives them."""
    cards = _cards(spark, sf_dir)
    state = persons.begun(cards.where("ord % 3 <> 0"))
    state, _ = persons.joined(state, cards.where("ord % 3 = 0"))
    return state.people.select("person", "name", "cards", "sources", joined("keys"), "first_ts", "last_ts", "avatar")


@query
def candidate_adjudication(spark, sf_dir):
    """Passes and models that agree on a merged candidate; a test compares the fold with one candidate after another."""
    rows = adapted.candidate(spark, sf_dir).withColumn("pass_id", F.concat(F.lit("pass-"), F.substring("id", -1, 1)))
    return merge.adjudicated(rows.withColumn("model", F.when(F.col("ord") % 2 == 0, "a").otherwise("b")), 4)


@query
def analysis_scopes(spark, sf_dir):
    """The messages that each scope and each choice of targets takes. Some conversations have been analyzed as they are, some before
    they changed, some never."""
    length = F.length("key")
    rows = keyed(spark, sf_dir).withColumn("own_kind", conversation_kind()).withColumn("ai_analyzed_at", F.when(F.length("content") % 4 == 0, "2024-03-01"))
    prints = evidence.fingerprints(rows, "key")
    marks = prints.where(length % 5 != 0).select("key", F.explode(F.array(F.lit("tasks"), F.lit("people"))).alias("target"), "digest")
    kept = F.when(F.col("target") == "tasks", F.octet_length("key") % 2 == 0).otherwise(F.right("key", F.lit(1)).isin("1", "3", "5", "7"))
    marks = marks.withColumn("digest", F.when(kept, F.col("digest")).otherwise("before"))
    out = None
    for scope, targets in (("all", ()), ("new", ()), ("pending", ("tasks",)), ("pending", ("people",)), ("pending", ("people", "tasks"))):
        part = evidence.scoped(rows, prints, marks, scope, frozenset(targets)).select(F.lit("+".join((scope, *targets))).alias("scope"), "id")
        out = part if out is None else out.unionAll(part)
    return out
