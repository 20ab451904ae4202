"""Queries of the workflows over the archive: what models see and send back, candidates and tasks, people."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions.columns import fnv1a36
from chatloom.operators import persons, records, segments, tasks
from chatloom.plans.queries import joined, keyed, query
from chatloom.sources import adapted

BUDGETS = {"core_rows": 40, "core_size": 6000, "overlap_rows": 4, "overlap_size": 800}


def _number(name: str):
    """The digits of an id as a number."""
    return F.regexp_replace(name, "[^0-9]", "").cast("long")


def _time():
    return [F.col("captured_ts").asc_nulls_last(), F.col("id")]


# Records -------------------------------------------------------------------------------------------------------------


def _model_rows(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("summary", F.when(F.col("id").endswith("-3"), F.concat(F.lit("note "), "id")))
    text = F.when(F.col("id").rlike("-[13]$"), "  ").otherwise(F.col("content"))
    return records.referenced(rows.select("id", "key", "captured_ts", records.model_text(text, F.col("summary")).alias("content"), records.known_role(F.col("speaker_role")).alias("role")), "key", _time())


@query
def model_records(spark, sf_dir):
    return _model_rows(spark, sf_dir).select("key", "ref", "id", F.sha2("content", 256).alias("content"), "role")


@query
def restored_references(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).select("key", "ref", "id")
    entries = rows.where("ref = '1'").select(F.concat(F.lit("entry "), "key").alias("entry"), "key", F.array(F.lit("2"), F.lit("99"), F.lit("1"), F.lit("5")).alias("refs"))
    return records.restored(entries, rows, "key").select("entry", joined("source_ids"))


@query
def self_plan(spark, sf_dir):
    plan = records.self_plan(records.self_records(adapted.message(spark, sf_dir)), BUDGETS)
    return segments.overlaps(plan, "target", "size", **BUDGETS).join(plan.groupBy("segment").agg(F.count("*").alias("rows")), "segment").select("segment", "first_place", "overlap", "rows")


def _observations(spark, sf_dir):
    """One a message of either side: a quote that is there, one that is not, and a text that is now and then a diagnosis."""
    rows = adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('o-', conv_id, '-', turn) AS observation",
        "CASE turn % 3 WHEN 0 THEN 'habit' ELSE 'event' END AS kind",
        "CASE WHEN conv_id % 6 = 0 THEN 'bipolar' ELSE concat('says ', conv_id) END AS text",
        "array(struct(concat('m-', conv_id, '-', turn) AS source_id, substring(text, 2, 12) AS quote), struct(concat('m-', conv_id, '-', turn + 1) AS source_id, substring(text, 2, 3) AS quote)) AS evidence",
    )
    messages = adapted.message(spark, sf_dir)
    return records.verified_observations(rows, messages, messages.where("status = 'new'").select("id"))


@query
def self_observations(spark, sf_dir):
    return _observations(spark, sf_dir).select("observation", "evidence", joined("source_ids"), "from_ts", "to_ts")


@query
def self_periods(spark, sf_dir):
    paragraphs = adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('p-', conv_id) AS period", "turn AS paragraph", "CASE WHEN turn = 2 THEN ' ' ELSE concat('paragraph ', turn) END AS text", "array(concat('o-', conv_id, '-', turn), concat('o-', conv_id, '-', turn + 1), concat('o-', conv_id, '-', turn)) AS observation_ids"
    )
    return records.resolved_periods(paragraphs, _observations(spark, sf_dir))


@query
def journal_rows(spark, sf_dir):
    entries = adapted.table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '-', turn) AS entry", "'me' AS name", "CASE WHEN turn % 4 = 1 THEN ' ' ELSE concat(' ', text) END AS content", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at")
    return records.journal_rows(entries).select("id", "title", F.sha2("summary", 256).alias("summary"), F.length("content").cast("long").alias("characters"), "message_type")


@query
def checkin_rows(spark, sf_dir):
    checkins = adapted.table(spark, sf_dir, "events").selectExpr(
        "date_format(date_add(DATE '2020-01-01', CAST(event_id % 20000 AS INT)), 'yyyy-MM-dd') AS date", "CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN event_id % 7 END AS mood", "CASE WHEN event_id % 3 > 0 THEN event_id % 12 END AS sleep",
        "CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'reduced' END AS medication", "CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'high' ELSE 'other' END AS alcohol", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS focus", "CASE WHEN event_id % 5 = 0 THEN 'note' END AS note",
    )
    return records.checkin_rows(checkins).select("id", "title", F.sha2("content", 256).alias("content"), "captured_at")


# Candidates and tasks ------------------------------------------------------------------------------------------------


def _raw(spark, sf_dir):
    return adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('r-', conv_id, '-', turn) AS id", "CAST(turn AS BIGINT) AS nth", "CASE turn % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'other' END AS action_owner", "CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE concat(' ', text) END AS title", "concat(text, text) AS description",
        "array(concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)) AS source_ids", "array(' Peer-1', '', concat('peer-', conv_id % 7)) AS people", "CASE WHEN turn % 2 = 0 THEN array('a', ' ', 'b') END AS tags",
        "CASE conv_id % 3 WHEN 0 THEN concat('Hall of NATION_', conv_id % 40) WHEN 1 THEN ' ' END AS place", "CASE turn % 3 WHEN 0 THEN 'exact' ELSE 'near' END AS location_precision", "CAST((conv_id - 5) * 1000.5 AS DOUBLE) AS radius",
    )


def _candidates(spark, sf_dir):
    return tasks.normalized(tasks.with_owner(_raw(spark, sf_dir), adapted.message(spark, sf_dir)))


@query
def candidates_normalized(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return rows.select("id", F.length("title").cast("long").alias("title"), F.length("description").cast("long").alias("description"), joined("source_ids"), joined("people"), joined("tags"), "place", "location_precision", "radius")


@query
def new_candidates(spark, sf_dir):
    rows = adapted.candidate(spark, sf_dir)
    return tasks.not_known_yet(rows.where("status = 'pending'"), rows.where("status <> 'pending'")).select("id", "title")


def _people(spark, sf_dir):
    return spark.range(7).selectExpr("concat('person-', id) AS person", "concat('Peer-', id, CASE WHEN id = 3 THEN ' x' ELSE '' END) AS name")


def _created(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("status", F.when(F.length("title") % 5 == 0, "dismissed").otherwise("pending"))
    there = rows.where("length(description) % 3 = 0").select(F.concat(F.lit("q-ai-"), "id").alias("id"))
    return tasks.tasks_of(rows, there, adapted.place(spark, sf_dir), _people(spark, sf_dir))


@query
def candidate_tasks(spark, sf_dir):
    return _created(spark, sf_dir).select("id", "location_id", joined("characters"), joined("tags"))


@query
def sources_reviewed(spark, sf_dir):
    return tasks.reviewed(adapted.message(spark, sf_dir), _created(spark, sf_dir)).groupBy("source", "status").agg(F.count("*").alias("messages"))


@query
def candidates_dismissed(spark, sf_dir):
    """Candidates and the feedback on them, told apart by what they are."""
    rows = adapted.candidate(spark, sf_dir).select("id", "status", "place")
    reasons = rows.where("status = 'pending' AND place = 'Library'").select("id", F.lit("other").alias("reason"))
    left, feedback = tasks.dismissed(rows.select("id", "status"), reasons)
    return left.groupBy(F.lit("candidates").alias("of"), "status").agg(F.count("*").alias("rows")).unionAll(feedback.groupBy(F.lit("feedback").alias("of"), F.col("reason").alias("status")).agg(F.count("*").alias("rows")))


def _quests(spark, sf_dir):
    """Tasks made of candidates: some without sources, some without a time, some of none."""
    return adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat(CASE WHEN turn % 5 = 0 THEN 'q-' ELSE 'q-ai-' END, 'c-', conv_id, '-', turn) AS id",
        "CASE WHEN turn % 2 = 0 THEN array(concat('m-', conv_id, '-', turn)) ELSE array() END AS source_ids",
        "CASE WHEN turn % 3 = 0 THEN TIMESTAMP_NTZ '2023-01-01 00:00:00' END AS source_at",
    )


@query
def task_evidence(spark, sf_dir):
    made = adapted.table(spark, sf_dir, "conversations").where("conv_id % 4 > 0").selectExpr("concat('c-', conv_id, '-', turn) AS id", "array(concat('m-', conv_id, '-', turn), 'm-0-0') AS source_ids", "CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP_NTZ '2023-02-02 00:00:00' END AS source_at", "TIMESTAMP_NTZ '2023-03-03 00:00:00' AS created_at")
    return tasks.evidence_restored(_quests(spark, sf_dir), made).select("id", F.coalesce(F.array_join("source_ids", ","), F.lit("")).alias("source_ids"), "source_at")


@query
def task_source_time(spark, sf_dir):
    return tasks.source_times(_quests(spark, sf_dir), adapted.message(spark, sf_dir))


@query
def place_removed(spark, sf_dir):
    return tasks.place_removed(adapted.task(spark, sf_dir), adapted.place(spark, sf_dir), 0).groupBy("location_id").agg(F.count("*").alias("tasks"))


@query
def generated_places(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "conversations").selectExpr("concat('c-', conv_id, '-', turn) AS id", "CASE turn % 4 WHEN 0 THEN concat('near nation_', conv_id % 30) WHEN 1 THEN concat('spot ', conv_id % 5) WHEN 2 THEN '' END AS place")
    known = spark.range(4).selectExpr("concat('spot ', id) AS query", "concat('found ', id) AS found")
    return tasks.generated_places(rows, adapted.place(spark, sf_dir), known)


def _dated_tasks(spark, sf_dir):
    number = _number("id")
    return adapted.task(spark, sf_dir).withColumn("start_ts", F.when(number % 6 > 0, F.col("start_ts"))).withColumn("long", number % 7 == 0)


@query
def task_list(spark, sf_dir):
    return tasks.listed(_dated_tasks(spark, sf_dir), "active", "URGENT").select("id", "title", "start_ts")


@query
def task_timeline(spark, sf_dir):
    return tasks.by_day(_dated_tasks(spark, sf_dir))


def _atlas(spark, sf_dir):
    number = _number("id")
    return adapted.task(spark, sf_dir).withColumn("category", F.element_at(F.array(F.lit("life"), F.lit("study"), F.lit("social")), (number % 3 + 1).cast("int"))).withColumn("atlas_order", F.when(number % 5 == 0, number % 11))


@query
def task_atlas_order(spark, sf_dir):
    return tasks.atlas(_atlas(spark, sf_dir), "category").select("id", "category", "place")


@query
def atlas_rearranged(spark, sf_dir):
    orders = spark.createDataFrame([("study", 0, ["t-3", "t-1", "t-2"]), ("life", 1, ["t-1", "t-4", "t-5"])], "category string, first int, ids array<string>")
    return tasks.rearranged(_atlas(spark, sf_dir), orders).select("id", "category", F.col("atlas_order").cast("long").alias("atlas_order"))


@query
def open_tasks(spark, sf_dir):
    """A report: the first thirty open tasks."""
    return adapted.task(spark, sf_dir).where("status IN ('active', 'available')").orderBy("start_ts", "id").limit(30).select("id", "status")


@query
def overview_counts(spark, sf_dir):
    return tasks.overview(adapted.task(spark, sf_dir), _people(spark, sf_dir), adapted.table(spark, sf_dir, "events").where("event_type = 'view'"), keyed(spark, sf_dir))


# People --------------------------------------------------------------------------------------------------------------


def _cards(spark, sf_dir):
    """A card a message of somebody else: names are written in several ways, sources lie between neighbours, some name their conversation."""
    return adapted.table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "concat('card-', conv_id, '-', turn) AS id", "CAST(conv_id * 100 + turn AS BIGINT) AS ord", "CASE WHEN turn % 4 = 1 THEN concat('PEER ', conv_id % 7) ELSE concat('peer-', conv_id % 7) END AS name",
        "array(concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn - turn % 4)) AS source_ids", "CASE WHEN turn > 3 THEN array(concat('conv-', conv_id % 20)) ELSE array() END AS keys",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id * 6 AS INT), CAST(turn * 7 AS INT), 0) AS first_ts", "TIMESTAMP_NTZ '2024-02-01 00:00:00' + make_dt_interval(0, CAST(conv_id * 6 AS INT), CAST(turn * 7 AS INT), 0) AS last_ts", "CASE WHEN turn % 3 = 0 THEN concat('http://a/', conv_id) END AS avatar",
    )


@query
def people_merge(spark, sf_dir):
    gone = spark.createDataFrame([("conv-2",)], "key string")
    return persons.merged(_cards(spark, sf_dir), gone).select("person", "name", "cards", "sources", joined("keys"), "first_ts", "last_ts", "avatar")


@query
def people_evidence(spark, sf_dir):
    messages = keyed(spark, sf_dir).select("id", "key", F.col("conversation_kind").alias("own_kind"), "speaker", "captured_ts", F.when(_number("id") % 4 == 0, F.concat(F.lit("http://p/"), "id")).alias("avatar"))
    people = _cards(spark, sf_dir).selectExpr("id AS person", "CASE WHEN ord % 2 = 0 THEN 'nobody' ELSE name END AS name", "source_ids", "array(concat('conv-', CAST(ord / 100 AS INT))) AS keys", "CASE WHEN ord % 3 = 0 THEN first_ts END AS first_ts", "CAST(NULL AS TIMESTAMP_NTZ) AS last_ts", "avatar")
    return persons.enriched(people, messages)


@query
def people_list(spark, sf_dir):
    rows = _cards(spark, sf_dir).groupBy("name").agg(F.max("last_ts").alias("last_ts"), F.count("*").alias("sources"), F.count_distinct(F.col("keys")).alias("conversations"))
    return persons.ordered(rows, "recent")


@query
def people_recent(spark, sf_dir):
    """A report: the twenty latest cards with a name."""
    return persons.searched(_cards(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" "), "id")), "Peer", 20).select("name", "last_ts")


@query
def newest_evidence(spark, sf_dir):
    """A report: the twelve latest claims of each person."""
    rows = adapted.claim(spark, sf_dir).selectExpr("person_id", "source_id AS claim_id", "claim_key AS text", "observed_ts AS first_ts", "CASE WHEN score % 4 > 0 THEN observed_ts END AS last_ts")
    return persons.newest_evidence(rows, 12).select("person_id", "claim_id", F.col("nth").cast("long").alias("nth"))


@query
def linked_records(spark, sf_dir):
    people = _cards(spark, sf_dir).selectExpr("name AS person", "source_ids", "keys")
    return persons.linked_records(people, keyed(spark, sf_dir)).groupBy("person").agg(F.count("*").alias("messages"), F.min("id").alias("first_id"))


@query
def device_summary(spark, sf_dir):
    events = adapted.context_event(spark, sf_dir).withColumn("source_file", F.when(F.col("kind") == "activity", "exports/Android/a.json").when(F.col("kind") == "payment", "C:/WINDOWS/b.json").when(F.col("kind") == "custom", "c.json"))
    return persons.devices(events)


@query
def reconciled_counts(spark, sf_dir):
    expected = adapted.message(spark, sf_dir).groupBy("source").agg((F.count("*") + F.when(F.col("source") == "journal", -1).when(F.col("source") == "export-a", 2).otherwise(0)).alias("expected"))
    return persons.reconciled_counts(expected, adapted.message(spark, sf_dir), "source")


@query
def distinct_places(spark, sf_dir):
    """Positions as decimals tell them: in doubles, 450 tenths of a millionth come out below the half that is rounded up."""
    found = adapted.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS query", "s_suppkey AS rank", "CAST((s_suppkey % 3) + 0.0000001BD * s_suppkey AS DOUBLE) AS lat", "CAST(s_suppkey % 2 AS DOUBLE) AS lon")
    return persons.distinct_places(found).select("query", "rank")


@query
def card_ids(spark, sf_dir):
    """Ids of cards as hashes, over names in both writings."""
    return _cards(spark, sf_dir).select("id", fnv1a36(F.concat_ws("|", "name", "id")).alias("hash"))
