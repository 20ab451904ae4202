"""Queries over shared states, portraits, payloads and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import times
from chatloom.operators import evidence, guidance, payloads, people, portraits, records, shared
from chatloom.plans.queries import AS_OF, joined, keyed, query
from chatloom.sources import adapted

# Shared states -------------------------------------------------------------------------------------------------------


def _states(spark, sf_dir) -> list[DataFrame]:
    """base, local and remote: each lacks some rows, and two have some changed."""
    parts = ", ".join(f"'{p}'" for p in (*shared.PARTS, "messages"))
    rows = adapted.table(spark, sf_dir, "events").selectExpr(f"array({parts})[CAST(event_id % 10 AS INT)] AS part", "concat('k-', event_id) AS id", "CAST(floor(event_id / 10) AS BIGINT) AS h")
    out = []
    for absent, changed, model, dismissal in ((11, 0, "4", "2"), (13, 5, "5", "2"), (17, 7, "4", "3")):
        value = f"h % 50 + CASE WHEN h % {changed} = 0 THEN 100 ELSE 0 END" if changed else "h % 50"
        state = rows.where(f"h % {absent} <> 0").selectExpr("part", "id", f"CASE WHEN part <> 'dismissed' THEN CAST({value} AS STRING) END AS value")
        versions = spark.range(1).selectExpr(f"explode(map('{shared.MODEL_VERSION}', '{model}', '{shared.DISMISSAL_VERSION}', '{dismissal}')) AS (id, value)").selectExpr("'setting' AS part", "id", "value")
        out.append(state.unionByName(versions))
    return out


@query
def shared_merge(spark, sf_dir):
    return shared.merged(*map(shared.projected, _states(spark, sf_dir)))


@query
def shared_differences(spark, sf_dir):
    base, local, remote = map(shared.projected, _states(spark, sf_dir))
    return shared.differences(shared.merged(base, local, remote), remote)


@query
def shared_hydrated(spark, sf_dir):
    base, local, remote = _states(spark, sf_dir)
    state, _ = shared.hydrated(local, shared.projected(base), shared.projected(remote), "5", "2")
    return state


# Portraits -----------------------------------------------------------------------------------------------------------


def _claims(spark, sf_dir) -> DataFrame:
    """Claims of every message of the other side, by the right name and by wrong ones; some hold a word that their quote has not."""
    rows = adapted.table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "concat('v-', conv_id, '-', turn) AS claim_id", "concat('a-', conv_id) AS card", "CAST(conv_id % 3 AS BIGINT) AS nth", "CASE conv_id % 3 WHEN 1 THEN 'me' ELSE concat('Peer-', conv_id % 7) END AS name",
        "concat('conv-', conv_id) AS key", "CASE WHEN conv_id % 2 = 0 THEN concat('PEER-', conv_id % 7) END AS expected", "CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind",
        "concat(CASE turn % 5 WHEN 0 THEN '喜欢' WHEN 1 THEN '今天' ELSE '' END, text) AS text", "CASE WHEN turn % 2 = 0 OR conv_id % 4 = 0 THEN substring(text, 2, 3) ELSE substring(text, 3, 9) END AS quote",
        "array(concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 2), concat('m-', conv_id, '-', turn)) AS source_ids",
    )
    return portraits.borne_out(rows, _messages(spark, sf_dir))


def _messages(spark, sf_dir) -> DataFrame:
    """Messages, of which some conversations name no speakers."""
    return keyed(spark, sf_dir).withColumn("speaker", F.when(~F.col("key").rlike("[05]$"), F.col("speaker")))


@query
def claims_borne_out(spark, sf_dir):
    return _claims(spark, sf_dir).select("claim_id", joined("source_ids"), "first_ts", "last_ts", "category", "stability", F.col("score").cast("long").alias("score"), "eligible")


@query
def person_cards(spark, sf_dir):
    rows = portraits.cards(_claims(spark, sf_dir), _messages(spark, sf_dir), keyed(spark, sf_dir).where("status = 'new'"))
    return rows.select("person", "name", "facts", "preferences", "events", "sources", "first_ts", "last_ts", joined("keys"), joined("platforms"))


def _registry(spark, sf_dir) -> DataFrame:
    """A claim a message, of which every third is of last summer."""
    when = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CASE WHEN turn % 3 = 1 THEN -200 ELSE 0 END, CAST(conv_id * 6 AS INT), CAST(turn * 7 AS INT), 0)"
    return adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('p-', conv_id) AS person", "concat('c-', turn) AS claim_id", "CAST(turn AS BIGINT) AS ord", "CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind", "text",
        "split_part(text, '.', 1) AS quote", "array(concat('m-', conv_id, '-', turn)) AS source_ids", "turn % 7 <> 5 AS eligible", "CAST(turn AS BIGINT) AS score", f"{when} AS first_ts", f"{when} AS last_ts",
    )


def _notes(spark, sf_dir) -> DataFrame:
    return adapted.table(spark, sf_dir, "conversations").where("turn = 0 AND conv_id % 3 = 0").selectExpr("concat('p-', conv_id) AS person", "concat(' likes walking by the river ', conv_id) AS notes")


@query
def resolved_claim_ids(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    asked = registry.selectExpr(
        "person", "kind", "ord AS pos", "CASE ord % 4 WHEN 0 THEN claim_id WHEN 1 THEN concat(claim_id, 'x') END AS claim_id", "CASE ord % 4 WHEN 1 THEN concat(' ', text, ' ') WHEN 3 THEN '' END AS text",
        "CASE WHEN ord % 4 = 2 THEN concat(quote, ' ') WHEN ord % 4 = 3 THEN 'no such' END AS quote",
    )
    return portraits.resolved_claims(asked, registry, 12)


def _blocks(spark, sf_dir) -> DataFrame:
    """A block a message, each by its number fit or breaking one rule."""
    said = "split_part(text, '.', 1)"
    blocks = adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('p-', conv_id) AS person", "CAST(turn + 1 AS BIGINT) AS pos",
        f"""CASE (conv_id + turn) % 10 WHEN 0 THEN '  ' WHEN 1 THEN concat({said}, '。证据不足') WHEN 3 THEN '####' WHEN 4 THEN concat({said}, ' 77年') WHEN 5 THEN '####' WHEN 6 THEN 'By the river, walking'
            WHEN 7 THEN concat({said}, '，尚不明确') WHEN 8 THEN concat('当时', {said}, '。') ELSE concat({said}, '。') END AS text""",
        "CASE (conv_id + turn) % 10 WHEN 5 THEN array('user-profile-notes') WHEN 6 THEN array('user-profile-notes') WHEN 9 THEN array(concat('c-', turn), concat('c-', turn - 1), 'c-99') ELSE array(concat('c-', turn)) END AS claim_ids",
        "CASE conv_id % 2 WHEN 0 THEN 'change' ELSE 'whatever' END AS reason",
    )
    return portraits.checked_blocks(blocks, _registry(spark, sf_dir), _notes(spark, sf_dir), AS_OF)


@query
def portrait_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("person", "pos", joined("claim_ids"), joined("source_ids"), "reason", "scope", "from_ts", "to_ts", "manual", "issue")


@query
def portraits_checked(spark, sf_dir):
    return portraits.checked_portraits(_blocks(spark, sf_dir), _registry(spark, sf_dir), _notes(spark, sf_dir), AS_OF)


@query
def portraits_consolidated(spark, sf_dir):
    attempts = adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('p-', conv_id) AS person", "CAST(turn + 1 AS BIGINT) AS attempt", "CASE (conv_id + turn) % 3 WHEN 0 THEN 'disclaimer' ELSE '' END AS issues",
        "CASE WHEN conv_id % 5 > 0 THEN concat('portrait ', turn) END AS portrait", "CAST(conv_id % 2 AS BIGINT) AS stated",
    )
    return portraits.consolidated(attempts, _registry(spark, sf_dir))


def _signatures(spark, sf_dir, version: str, edited: bool = False) -> DataFrame:
    registry = _registry(spark, sf_dir)
    if edited:
        registry = registry.withColumn("score", F.when(F.expr("person LIKE '%7' AND ord = 1"), F.lit(99)).otherwise(F.col("score")))
    return portraits.signatures(registry, _notes(spark, sf_dir), version)


@query
def portrait_signatures(spark, sf_dir):
    """Whose signature changes when a claim of theirs does."""
    before, after = _signatures(spark, sf_dir, "1"), _signatures(spark, sf_dir, "1", True)
    return before.join(after.withColumnRenamed("signature", "after"), "person").select("person", (F.col("signature") != F.col("after")).alias("changed"))


@query
def consolidation_queue(spark, sf_dir):
    """A report: the first twelve people who are due."""
    before, after = _signatures(spark, sf_dir, "1"), _signatures(spark, sf_dir, "1", True)
    number = F.regexp_replace("person", "[^0-9]", "").cast("long")
    known = before.select("person", number.alias("ord"), F.when(number % 4 > 0, F.col("signature")).alias("signature"), F.when(number % 5 > 0, number % 5).alias("retries"))
    return portraits.queue(known, after, before.where(number % 9 == 0), 12)


# Payloads and judges -------------------------------------------------------------------------------------------------


@query
def payload_checks(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "conversations")
    of = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = of.selectExpr(
        "concat('y-', conv_id) AS payload", "CASE WHEN conv_id % 11 = 1 THEN n - 1 WHEN conv_id % 2 = 0 THEN n + 5 END AS total", "CASE WHEN conv_id % 11 = 2 THEN n + 1 WHEN conv_id % 3 = 0 THEN n END AS declared",
        "CASE WHEN conv_id % 11 = 3 THEN 3 WHEN conv_id % 11 = 4 THEN 1 WHEN conv_id % 2 = 0 THEN 1 END AS segment", "CASE WHEN conv_id % 11 = 4 THEN NULL WHEN conv_id % 2 = 0 OR conv_id % 11 = 3 THEN 2 END AS segments",
        "CASE WHEN conv_id % 11 = 5 THEN array(CAST(1 AS BIGINT), n + 1) WHEN conv_id % 11 = 6 THEN array() WHEN conv_id % 2 = 1 THEN array(CAST(1 AS BIGINT), n) END AS core",
    ).unionAll(spark.range(1).selectExpr("'y-none'", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "NULL", "NULL", "NULL"))
    held = rows.selectExpr("concat('y-', conv_id) AS payload", "concat('m-', conv_id, '-', turn) AS id", "CASE WHEN turn % 2 = 0 THEN text WHEN conv_id % 11 = 7 AND turn = 1 THEN ' ' END AS content", "CASE WHEN conv_id % 11 <> 7 OR turn <> 1 THEN text END AS summary")
    files = of.selectExpr("concat('y-', conv_id) AS payload", "explode(sequence(1, CASE WHEN conv_id % 11 = 8 THEN 5 ELSE 2 END)) AS f", "conv_id").selectExpr("payload", "'image/png' AS mime", "CASE WHEN conv_id % 11 = 9 THEN 0 ELSE 100 * f END AS size")
    return payloads.checked(asked, held, files)


def _sent(spark, sf_dir) -> DataFrame:
    return payloads.merge_claims(
        adapted.table(spark, sf_dir, "conversations").selectExpr(
            "concat('y-', conv_id % 25) AS payload", "CAST(conv_id * 100 + turn AS BIGINT) AS ord", "CASE WHEN turn % 2 = 0 THEN concat('c-', conv_id, '-', turn) END AS id", "CASE turn % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'preference' WHEN 2 THEN 'other' END AS kind", "text",
            "CASE WHEN turn = 3 THEN ' ' ELSE split_part(text, '.', 1) END AS quote", "array('', concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn)) AS source_ids", "CASE WHEN conv_id % 2 = 0 THEN 'repeated' END AS strength",
            "CASE turn % 5 WHEN 0 THEN 'temporary' WHEN 1 THEN 'skill' WHEN 2 THEN 'nothing' END AS category", "CASE WHEN turn = 4 THEN 'persistent' END AS stability", "CAST(turn * 3 - 4 AS BIGINT) AS score", "CASE WHEN turn = 6 THEN false END AS eligible",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id * 6 AS INT), 0, 0) AS first_ts", "CAST(NULL AS TIMESTAMP_NTZ) AS last_ts",
        )
    )


@query
def merge_payload_claims(spark, sf_dir):
    return _sent(spark, sf_dir).select("payload", "id", "kind", joined("source_ids"), "strength", "category", "stability", "score", "eligible")


@query
def merge_payloads(spark, sf_dir):
    asked = spark.range(40).selectExpr("concat('y-', id) AS payload", "CASE WHEN id % 8 = 1 THEN ' ' ELSE concat('peer-', id) END AS name", "CASE id % 3 WHEN 0 THEN array('a', ' a', 'b') WHEN 1 THEN array('a', 'a ') END AS facts", "CASE WHEN id % 5 = 0 THEN 'notes' END AS notes")
    return payloads.merge_payloads(asked, _sent(spark, sf_dir))


@query
def payload_times(spark, sf_dir):
    """The time summary and the spans of what is sent, as of claims anywhere."""
    cited = _sent(spark, sf_dir).select("payload", F.coalesce("last_ts", "first_ts").alias("observed_ts"), F.explode("source_ids").alias("source_id"))
    return evidence.scope_summary(cited, AS_OF, "payload").join(people.block_times(cited, AS_OF, "payload"), "payload")


@query
def self_payloads(spark, sf_dir):
    return payloads.self_only(keyed(spark, sf_dir).withColumn("payload", F.when(F.col("speaker_role") == "self", F.concat("key", F.lit(" self"))).otherwise(F.col("key"))))


@query
def coarse_events(spark, sf_dir):
    rows = adapted.context_event(spark, sf_dir).selectExpr(
        "concat('y-', user_id) AS payload", "CAST(substring(id, 3) AS BIGINT) AS ord", "id", "CASE WHEN kind = 'device' THEN 'location' WHEN kind = 'custom' THEN 'odd' ELSE kind END AS kind", "CASE WHEN kind = 'payment' THEN ' ' ELSE title END AS title",
        "concat('at ', user_id) AS summary", "start_ts", "CASE WHEN user_id % 2 = 0 THEN end_ts ELSE TIMESTAMP_NTZ '2000-01-01 00:00:00' END AS end_ts",
    )
    return payloads.coarse_events(rows)


@query
def self_payload_observations(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('y-', conv_id % 3) AS payload", "CAST(conv_id * 100 + turn AS BIGINT) AS ord", "concat('o-', conv_id, '-', turn) AS id", "CASE turn % 3 WHEN 0 THEN 'routine' WHEN 1 THEN 'mood' END AS kind", "CASE WHEN turn = 2 THEN ' ' ELSE text END AS text",
        "array('', concat('m-', conv_id), concat('m-', conv_id)) AS source_ids", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS from_ts", "CASE WHEN conv_id % 4 > 0 THEN TIMESTAMP_NTZ '2024-01-02 00:00:00' END AS to_ts",
    )
    return payloads.self_observations(rows).select("payload", "id", "kind", F.sha2("text", 256).alias("text"), joined("source_ids"))


@query
def judge_inputs(spark, sf_dir):
    rows = adapted.claim(spark, sf_dir).selectExpr("person_id AS key", "concat(source_id, kind, observed_ts) AS observation", "concat('model-', score % 2) AS participant", "CASE WHEN score % 5 = 0 THEN 'needs-review' WHEN score % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS validation", "source_id")
    return payloads.judge_inputs(rows)


# Advice and times ----------------------------------------------------------------------------------------------------


@query
def advice_risks(spark, sf_dir):
    rows = adapted.message(spark, sf_dir).selectExpr("id", "concat(CASE WHEN id LIKE '%-1' THEN '欲擒故纵，' WHEN id LIKE '%-2' THEN '对方 肯定 喜欢你' WHEN id LIKE '%-4' THEN '她喜欢你' ELSE '' END, CASE WHEN id LIKE '%-3' THEN ' ' ELSE content END) AS advice")
    return rows.select("id", guidance.risk(F.col("advice")).alias("risk"))


@query
def guidance_current(spark, sf_dir):
    """Answers of which some were asked about other people, another place or another text."""
    tasks = adapted.task(spark, sf_dir).selectExpr(
        "id", "title", "'' AS description", "date_format(start_ts, 'yyyy-MM-dd') AS start_at", "CAST(NULL AS STRING) AS due_at", "location_id",
        "transform(sequence(0, CAST(location_id % 3 AS INT)), x -> concat('person-', (location_id + x) % 7)) AS people",
    )
    cast = spark.range(7).selectExpr("concat('person-', id) AS person", "concat('portrait ', id) AS portrait", "'' AS notes", "array('a') AS facts")
    places = adapted.place(spark, sf_dir).selectExpr("place_id", "name", "CAST(place_id AS DOUBLE) AS lat", "1.0D AS lon", "'' AS note")
    asked = guidance.signatures(tasks, cast, places)
    edited = guidance.signatures(tasks.withColumn("title", F.when(F.col("id").endswith("7"), F.lit("new")).otherwise(F.col("title"))), cast.withColumn("portrait", F.when(F.col("person") == "person-3", F.lit("new")).otherwise(F.col("portrait"))), places.withColumn("name", F.when(F.col("place_id") == 20, F.lit("new")).otherwise(F.col("name"))))
    answers = tasks.select("id", F.when(F.col("id").endswith("4"), F.array(F.lit("person-0"))).otherwise(F.col("people")).alias("people")).join(asked, "id")
    return guidance.current(answers, tasks, edited).select("id")


@query
def task_times(spark, sf_dir):
    rows = adapted.message(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id LIKE '%-1' THEN '2024-02-30' WHEN id LIKE '%-5' THEN ' soon ' WHEN id NOT LIKE '%-4' AND id NOT LIKE '%-6' THEN date_format(captured_ts, 'yyyy-MM-dd') END AS start_at",
        "CASE WHEN id LIKE '%-2' THEN date_format(captured_ts, 'yyyy-MM-dd') WHEN id LIKE '%-3' OR id LIKE '%-4' THEN date_format(captured_ts, 'yyyy-MM-dd HH:mm') END AS due_at", "date_format(captured_ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS source_at",
    )
    return times.labelled_tasks(rows).select("id", "target", "told", "clock", "day")


@query
def local_dates(spark, sf_dir):
    rows = adapted.context_event(spark, sf_dir).selectExpr("id", "start_ts", "element_at(array('Asia/Tokyo', 'America/New_York', 'Mars/Base', 'UTC'), CAST(user_id % 4 AS INT) + 1) AS zone", "CASE WHEN user_id % 3 > 0 THEN CAST((user_id % 40) * 50 - 1000 AS DOUBLE) END AS minutes")
    return times.local_dates(rows, "start_ts", "zone", "UTC").select("id", "zone", "date", times.offset_label(F.col("minutes")).alias("offset"))


@query
def person_summaries(spark, sf_dir):
    rows = spark.range(7).selectExpr("concat('p-', id) AS person", "CASE WHEN id = 2 THEN ' ' ELSE concat('peer-', id) END AS name", "CAST(NULL AS TIMESTAMP_NTZ) AS last_ts", "repeat('ab', 300) AS portrait")
    return records.person_summaries(rows, _registry(spark, sf_dir)).select("id", "name", F.length("portrait").cast("long").alias("portrait"), "facts", "preferences")
