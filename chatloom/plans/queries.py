"""The catalogue's queries: each applies an operator to its whole table, as sources/adapted.py dresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.columns import captured_at, char_grams, compact_key, fnv1a36, relevance, row_size, text_key, utf16_length
from chatloom.functions import claims, normalize
from chatloom.operators import archive, browse, ensemble, evidence, gates, links, merge, people, segments
from chatloom.sources import adapted
from chatloom.sources.staging import new_path

AS_OF = "2024-01-20 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(array: str) -> Column:
    return F.array_join(array, ",").alias(array)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.keyed(adapted.message(spark, sf_dir))


# Browsing ------------------------------------------------------------------------------------------------------------


@query
def conversation_index(spark, sf_dir):
    return browse.conversation_index(adapted.message(spark, sf_dir))


@query
def conversation_first_page(spark, sf_dir):
    """A report: the 120 conversations that are latest."""
    return browse.recent_first(browse.conversation_index(adapted.message(spark, sf_dir)), 120).select("key", "last_ts", "messages")


@query
def conversation_search(spark, sf_dir):
    return browse.search(browse.conversation_index(adapted.message(spark, sf_dir)), "ation 1").select("key", "name", "source", "messages")


@query
def keyset_page(spark, sf_dir):
    """A report: the page behind one conversation."""
    index = browse.conversation_index(adapted.message(spark, sf_dir))
    return browse.index_page(index, ("conv-40", "2024-01-11 00:28:00"), 25).select("key", "last_ts")


@query
def conversation_page(spark, sf_dir):
    """A report: one conversation's first page."""
    return browse.conversation_page(adapted.message(spark, sf_dir), "conv-12", limit=200).select("id", "captured_ts", "speaker_role")


@query
def conversation_timeline(spark, sf_dir):
    return browse.timeline(adapted.message(spark, sf_dir))


@query
def timeline_buckets(spark, sf_dir):
    return browse.timeline(adapted.message(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("conversations"), F.sum("messages").alias("messages"))


@query
def archive_summary(spark, sf_dir):
    return browse.archive_summary(adapted.message(spark, sf_dir))


@query
def interaction_summary(spark, sf_dir):
    return browse.interaction_summary(adapted.message(spark, sf_dir).where("speaker IS NOT NULL"), "speaker")


@query
def direction_pivot(spark, sf_dir):
    return browse.directions(adapted.message(spark, sf_dir))


@query
def counterpart_mode(spark, sf_dir):
    return browse.counterparts(adapted.message(spark, sf_dir))


@query
def unique_counterpart(spark, sf_dir):
    return browse.only_counterparts(adapted.message(spark, sf_dir), "somebody")


@query
def fallback_people(spark, sf_dir):
    return browse.fallback_people(adapted.message(spark, sf_dir))


@query
def strict_time_range(spark, sf_dir):
    return browse.dated_between(adapted.message(spark, sf_dir), "2024-01-03", "2024-01-09").select("id", "captured_ts")


@query
def overlap_range(spark, sf_dir):
    return browse.touching(browse.conversation_index(adapted.message(spark, sf_dir)), "2024-01-03", "2024-01-09").select("key", "first_ts", "last_ts")


@query
def newest_per_source(spark, sf_dir):
    """A report: the 80 newest messages of each source."""
    return browse.newest(adapted.message(spark, sf_dir), "captured_ts", 80, "source").select("source", F.col("rank").cast("long").alias("rank"), "id")


@query
def source_counts(spark, sf_dir):
    rows = adapted.message(spark, sf_dir)
    return rows.groupBy("source", "status").agg(F.count("*").alias("messages"), F.count_if(F.col("captured_ts").isNull()).alias("undated"))


# The archive ---------------------------------------------------------------------------------------------------------


@query
def op_log_current_state(spark, sf_dir):
    return archive.current(adapted.op_log(spark, sf_dir), "seq", "ord").select("id", "value", "seq")


@query
def change_feed(spark, sf_dir):
    return archive.changes(adapted.op_log(spark, sf_dir), 20, "seq", "ord").select("id", "op", "value")


def _states(spark, sf_dir):
    ops = adapted.op_log(spark, sf_dir)
    return archive.current(ops.where("seq <= 15"), "seq", "ord").select("id", "value"), archive.current(ops, "seq", "ord").select("id", "value")


@query
def snapshot_diff(spark, sf_dir):
    return archive.difference(*_states(spark, sf_dir))


@query
def effective_delta(spark, sf_dir):
    ops = adapted.op_log(spark, sf_dir)
    state = archive.current(ops.where("seq <= 15"), "seq", "ord").select("id", "value")
    late = archive.latest(ops.where("seq > 15"), "seq", "ord")
    return archive.effective(state, late.where("op = 'upsert'").select("id", "value"), ops.where("seq > 15 AND op = 'delete'").select("id"))


@query
def event_upsert_counts(spark, sf_dir):
    return archive.upsert_counts(*_states(spark, sf_dir))


@query
def conflict_reconcile(spark, sf_dir):
    """Local rows over remote ones."""
    old, new = _states(spark, sf_dir)
    return archive.reconciled(old.where("value > 5"), new)


@query
def avatar_first_only(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("avatar", F.concat(F.lit("http://a/"), "speaker"))
    return archive.first_only(rows, "avatar", ["key", "speaker"], [F.col("captured_ts").asc_nulls_last(), F.col("id")]).select("id", "avatar")


@query
def retention_budget(spark, sf_dir):
    files = adapted.table(spark, sf_dir, "events").selectExpr("user_id", "concat('f-', event_id) AS name", "ts AS at", "CAST(floor(value * 100) AS BIGINT) AS bytes")
    return gates.kept_within(files, 20, 15_000, "user_id")


@query
def archive_round_trip(spark, sf_dir):
    """A commit of all events and its verification: rows read back, versions that are not what was written."""
    held = archive.Archive(spark, new_path(spark, "archive"))
    held.commit(adapted.context_event(spark, sf_dir))
    bad = held.verify()
    return held.snapshot().agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.max("start_ts").alias("latest")).withColumn("bad", F.lit(len(bad)).cast("long"))


# Segments ------------------------------------------------------------------------------------------------------------


def _sized_events(spark, sf_dir):
    rows = adapted.context_event(spark, sf_dir).withColumn("size", (F.length("id") * 7 + F.length("kind") * 5).cast("long"))
    return segments.placed(rows, "user_id", [F.col("start_ts"), F.col("id")])


EVENTS = {"core_rows": 12, "core_size": 900, "overlap_rows": 4, "overlap_size": 200}


@query
def greedy_segments(spark, sf_dir):
    return segments.segments(_sized_events(spark, sf_dir), "user_id", "size", **EVENTS).select("id", "user_id", "place", "segment")


@query
def segment_overlap(spark, sf_dir):
    cut = segments.segments(_sized_events(spark, sf_dir), "user_id", "size", **EVENTS)
    return segments.overlaps(cut, "user_id", "size", **EVENTS)


def _plan(spark, sf_dir):
    cut = segments.segments(_sized_events(spark, sf_dir), "user_id", "size", **EVENTS)
    return segments.plan(cut, "user_id", "start_ts", "2024-04-01 00:00:00")


@query
def segment_priority(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def segment_interleave(spark, sf_dir):
    return segments.interleaved(_plan(spark, sf_dir), "user_id").select("user_id", "segment", "total", "turn")


@query
def conversation_segments(spark, sf_dir):
    """Conversations cut by the sizes of their rows, a budget that their few rows reach."""
    rows = segments.placed(keyed(spark, sf_dir).withColumn("size", row_size()), "key", [F.col("captured_ts").asc_nulls_last(), F.col("id")])
    cut = segments.segments(rows, "key", "size", core_rows=3, core_size=1500)
    return cut.groupBy("key", "segment").agg(F.count("*").alias("rows"), F.min("place").alias("first_place"))


@query
def quarter_chunks(spark, sf_dir):
    rows = adapted.context_event(spark, sf_dir).select("id", "user_id", "start_ts")
    return segments.calendar_chunks(rows, "start_ts", 25, "user_id").groupBy("user_id", "quarter", "chunk").agg(F.count("*").alias("rows"))


@query
def ref_ranges(spark, sf_dir):
    """The order numbers of each status as runs."""
    rows = adapted.table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("long").alias("ref"))
    return segments.ranges(rows, "ref", "o_orderstatus")


# Incremental work ----------------------------------------------------------------------------------------------------


@query
def incremental_context(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("new", F.col("id").endswith("-5"))
    return links.with_context(rows, "new", 3, "key", [F.col("captured_ts").asc_nulls_last(), F.col("id")]).select("id", "key", "new")


@query
def full_conversation_semi(spark, sf_dir):
    rows = adapted.message(spark, sf_dir)
    return links.whole_conversations(rows, rows.where("length(content) % 11 = 0")).select("id", "key")


@query
def carry_forward_time(spark, sf_dir):
    return links.carried_forward(keyed(spark, sf_dir), "captured_ts", "key", [F.col("id")]).select("id", "captured_ts")


@query
def conversation_fingerprint(spark, sf_dir):
    return evidence.fingerprints(keyed(spark, sf_dir), "key")


@query
def complete_coverage(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return evidence.completed(rows, rows.where("length(content) % 9 <> 0").select("id"), "key")


@query
def pending_rows(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    seen = evidence.fingerprints(rows.where("length(content) % 13 <> 0"), "key")
    return evidence.pending(rows, seen, "key")


# Events, tasks, places -----------------------------------------------------------------------------------------------


@query
def event_interval_overlap(spark, sf_dir):
    events = adapted.context_event(spark, sf_dir)
    spans = events.where("kind = 'activity'").select("user_id", F.col("id").alias("span"), F.col("start_ts").alias("first_ts"), F.expr("start_ts + INTERVAL 2 HOURS").alias("last_ts"))
    return links.overlapping(events, spans, ["user_id"], 3600 * 6).groupBy("span").agg(F.count("*").alias("events"), F.min("id").alias("first_event"))


@query
def privacy_projection(spark, sf_dir):
    events = adapted.context_event(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "device", "location").otherwise(F.col("kind")))
    return links.coarse_events(events)


@query
def place_active_counts(spark, sf_dir):
    return links.active_counts(adapted.place(spark, sf_dir), adapted.task(spark, sf_dir))


@query
def task_children_detached(spark, sf_dir):
    tasks = adapted.task(spark, sf_dir)
    return links.unlocked_children(tasks, tasks.where("status = 'done' AND parent_id IS NULL").select("id")).select("id", "status", "parent_id")


@query
def dangling_cleanup(spark, sf_dir):
    tasks = adapted.task(spark, sf_dir).selectExpr("id", "array(coalesce(parent_id, 'none'), id, concat(id, 'x')) AS people")
    known = adapted.task(spark, sf_dir).where("status <> 'done'").select(F.col("id").alias("known"))
    return links.without_dangling(tasks, "people", known, "known").select("id", joined("people"))


@query
def substring_match(spark, sf_dir):
    names = adapted.table(spark, sf_dir, "supplier").selectExpr("CASE s_suppkey % 4 WHEN 0 THEN concat('Office NATION_', s_nationkey) WHEN 1 THEN concat('nation _', s_nationkey, ' branch') WHEN 2 THEN concat('ATION_', s_nationkey % 3) ELSE 'nowhere' END AS name")
    return links.name_matches(names, adapted.place(spark, sf_dir).select(F.col("name").alias("place"), "place_id"), "name", "place", "place_id")


@query
def task_person_links(spark, sf_dir):
    rows = adapted.message(spark, sf_dir)
    sources = adapted.table(spark, sf_dir, "conversations").selectExpr("concat('t-', conv_id) AS task", "concat('m-', conv_id, '-', turn) AS id")
    people = spark.range(7).selectExpr("concat('p-', id) AS person", "concat('Peer - ', id) AS name", "CASE WHEN id % 2 = 0 THEN concat('conv-', id * 3) END AS key")
    people = people.withColumn("name", F.regexp_replace("name", " - ", "-"))
    tasks = sources.select(F.col("task").alias("id")).distinct()
    return links.person_links(tasks, sources, rows, people)


# Claims --------------------------------------------------------------------------------------------------------------


@query
def claim_merge(spark, sf_dir):
    return evidence.merged_claims(adapted.claim(spark, sf_dir), "person_id", "kind", "claim_key")


@query
def claim_scope_summary(spark, sf_dir):
    return evidence.scope_summary(adapted.claim(spark, sf_dir), AS_OF, "person_id")


@query
def claim_stability(spark, sf_dir):
    merged = evidence.merged_claims(adapted.claim(spark, sf_dir), "person_id", "kind", "claim_key")
    return merged.select("person_id", "kind", "claim_key", evidence.stability(F.col("n_sources"), F.col("first_ts"), F.col("last_ts")).alias("stability"))


@query
def evidence_clusters(spark, sf_dir):
    rows = adapted.claim(spark, sf_dir).selectExpr("concat(source_id, kind) AS observation", "person_id AS participant", "CASE WHEN score % 5 = 0 THEN 'needs-review' WHEN score % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS validation", "concat('s-', substring(source_id, 3, 2)) AS source_id")
    return ensemble.clusters(rows)


@query
def best_claim_per_month(spark, sf_dir):
    return evidence.best_each_month(adapted.claim(spark, sf_dir), "person_id").select("person_id", "month", "source_id", "score")


@query
def profile_workset(spark, sf_dir):
    rows = adapted.claim(spark, sf_dir).withColumn("strength", F.when(F.col("score") % 4 == 0, "repeated").otherwise("single"))
    rows = rows.withColumn("category", F.when(F.col("score") % 6 == 0, "boundary").when(F.col("score") % 6 == 1, "interaction").when(F.col("score") % 6 == 2, "temporary").otherwise("preference"))
    return evidence.workset(rows, AS_OF, limit=20).select("person_id", "source_id", F.col("place").cast("long").alias("place"))


@query
def verified_claims(spark, sf_dir):
    claims = adapted.table(spark, sf_dir, "conversations").selectExpr("concat('q-', conv_id, '-', turn) AS claim_id", "substring(text, 3, 9) AS quote", "array(concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)) AS source_ids")
    return evidence.verified(claims, adapted.message(spark, sf_dir)).select("claim_id", joined("source_ids"), "first_ts")


# Merging -------------------------------------------------------------------------------------------------------------


def _three(spark, sf_dir):
    rows = adapted.op_log(spark, sf_dir).where("op = 'upsert'").groupBy("id").agg(F.max("value").alias("value"))
    base = rows.where("CAST(floor(value) AS INT) % 7 <> 0")
    local = rows.where("CAST(floor(value) AS INT) % 5 <> 0").withColumn("value", F.expr("CASE WHEN CAST(floor(value) AS INT) % 3 = 0 THEN value + 1 ELSE value END"))
    remote = rows.where("CAST(floor(value) AS INT) % 11 <> 0").withColumn("value", F.expr("CASE WHEN CAST(floor(value) AS INT) % 2 = 0 THEN value + 2 ELSE value END"))
    return base, local, remote


@query
def three_way_merge(spark, sf_dir):
    return merge.three_way(*_three(spark, sf_dir), "value")


@query
def three_way_set(spark, sf_dir):
    return merge.three_way_set(*[df.select("id") for df in _three(spark, sf_dir)])


@query
def three_way_map(spark, sf_dir):
    return merge.three_way_map(*_three(spark, sf_dir))


@query
def manual_retain(spark, sf_dir):
    rows = adapted.message(spark, sf_dir).select("id", "source", "status")
    imported = rows.where("length(id) % 2 = 0").withColumn("status", F.lit("imported"))
    return merge.manual_kept(imported, rows, F.col("source") == "journal")


@query
def candidate_dup_pairs(spark, sf_dir):
    return merge.duplicate_pairs(adapted.candidate(spark, sf_dir))


@query
def candidate_fold(spark, sf_dir):
    return merge.merged_candidates(adapted.candidate(spark, sf_dir))


def _dated(spark, sf_dir):
    """Candidates of every fate: passing and submission tasks, reversed offers, thin ones, with and without dates and evidence."""
    return adapted.table(spark, sf_dir, "conversations").selectExpr(
        "concat('g-', conv_id, '-', turn) AS id",
        "CASE (conv_id + turn) % 6 WHEN 0 THEN concat('取快递 ', split_part(text, '.', 1)) WHEN 1 THEN concat('提交问卷 ', split_part(text, '.', 1)) WHEN 2 THEN '之后请你喝咖啡' WHEN 3 THEN 'x' ELSE split_part(text, '.', 1) END AS title",
        "CASE WHEN turn % 5 = 4 THEN ' y ' ELSE text END AS description",
        "CASE WHEN conv_id % 8 = 0 THEN array('m-none') ELSE array(concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)) END AS source_ids",
        "CASE (conv_id + 2 * turn) % 7 WHEN 1 THEN '2024-01-05' WHEN 2 THEN '2024-03-01' END AS start_at",
        "CASE (conv_id + turn) % 5 WHEN 0 THEN '2024-02-20' WHEN 1 THEN '2024-01-30' END AS due_at",
    )


def _said(spark, sf_dir):
    """Messages that now and then ask, offer, or name a day."""
    content = "CASE length(content) % 5 WHEN 0 THEN concat('请你 ', content) WHEN 1 THEN concat('我请你 ', content) WHEN 2 THEN concat('我请他 ', content) WHEN 3 THEN concat('2024年3月5日 ', content) ELSE content END AS content"
    return adapted.message(spark, sf_dir).selectExpr("id", "speaker_role", "captured_ts", content)


@query
def candidate_gate_counts(spark, sf_dir):
    rows = _dated(spark, sf_dir)
    proof = gates.evidence(rows.select("id", F.explode("source_ids").alias("source_id")), _said(spark, sf_dir))
    return gates.judged(rows.drop("source_ids"), proof, "2024-02-10 00:00:00").groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("candidates"))


@query
def action_score_top(spark, sf_dir):
    """A report: the hundred messages that ask most for something to be done."""
    rows = adapted.message(spark, sf_dir).withColumn("content", F.concat(F.when(F.length("content") % 5 == 0, "记得明天提交 ").otherwise(""), "content"))
    return gates.task_like(rows).orderBy(F.desc("score"), F.col("captured_ts").desc_nulls_last(), "id").limit(100).select("id", F.col("score").cast("long").alias("score"))


# Scalar functions ----------------------------------------------------------------------------------------------------


@query
def text_keys(spark, sf_dir):
    rows = adapted.message(spark, sf_dir)
    return rows.select("id", text_key(F.col("content")).alias("text_key"), compact_key(F.col("content")).alias("compact"), F.array_join(char_grams(F.col("content"), most=36), "|").alias("grams"))


@query
def message_relevance(spark, sf_dir):
    return adapted.message(spark, sf_dir).select("id", relevance(F.col("captured_ts"), "2024-02-20 00:00:00").alias("relevance"))


@query
def fnv_ids(spark, sf_dir):
    """Ids as hashes of UTF-16 units; a test compares them with another implementation."""
    return adapted.message(spark, sf_dir).select("id", fnv1a36(F.col("id")).alias("hash"), utf16_length(F.col("content")).cast("long").alias("units"))


@query
def normalized_times(spark, sf_dir):
    """Exported times in their several spellings."""
    days = adapted.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "day", F.lit(" 08:05]"))).when(F.col("event_id") % 5 == 1, F.regexp_replace("day", r"(\d+)-(\d+)-(\d+)", "$1年$2月$3日 7时30分")).when(F.col("event_id") % 5 == 2, F.col("epoch").cast("string")).when(F.col("event_id") % 5 == 3, F.col("day")).otherwise(F.lit("2024-02-30 10:00:00"))
    return days.select("event_id", captured_at(raw).alias("captured_at"))


# People --------------------------------------------------------------------------------------------------------------


@query
def counterpart_identity(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    names = rows.select("key").distinct().select("key", F.concat(F.lit("Peer-"), F.length("key") % 7).alias("returned"), F.lit(None).cast("string").alias("expected"))
    return people.counterpart_rows(rows, names)


@query
def dismissed_people(spark, sf_dir):
    cards = keyed(spark, sf_dir).where("speaker_role = 'other'").groupBy(F.col("speaker").alias("id")).agg(F.collect_set("key").alias("keys"))
    gone = spark.createDataFrame([("conv-12",), ("conv-15",)], "key string")
    return people.not_dismissed(cards, gone).select("id", F.size("keys").cast("long").alias("conversations"))


@query
def observation_merge(spark, sf_dir):
    rows = adapted.claim(spark, sf_dir).selectExpr("concat(person_id, ':', kind) AS id", "source_id", "claim_key AS quote", "observed_ts AS from_ts", "observed_ts AS to_ts")
    return people.merged_observations(rows)


@query
def block_times(spark, sf_dir):
    return people.block_times(adapted.claim(spark, sf_dir), "2024-02-12 00:00:00", "person_id", "kind")


@query
def portrait_coverage(spark, sf_dir):
    return people.coverage(adapted.claim(spark, sf_dir), "person_id")


@query
def latest_per_user(spark, sf_dir):
    return people.last_known(adapted.context_event(spark, sf_dir).select("user_id", "kind", "start_ts", "id"), ["user_id", "kind"], ["start_ts", "id"]).select("user_id", "kind", "id")


@query
def carry_over(spark, sf_dir):
    return people.carried_over(*_states(spark, sf_dir), "id")


# Several models ------------------------------------------------------------------------------------------------------


@query
def model_passes(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "concat('x-', p_partkey) AS id", "CASE WHEN p_size % 4 = 0 THEN 'judge' ELSE 'extractor' END AS role", "CASE WHEN p_size % 2 = 0 THEN 'people' ELSE 'tasks' END AS workflow", "p_size > 10 AS enabled")
    return ensemble.passes(rows, "people", 3).select("id", "role")


@query
def ensemble_plan(spark, sf_dir):
    """Cuts of direct conversations for two extractors; a test compares them with a model."""
    rows = segments.placed(keyed(spark, sf_dir).withColumn("size", row_size()), "key", [F.col("captured_ts").asc_nulls_last(), F.col("id")])
    chosen = spark.createDataFrame([("x", "extractor", "small"), ("y", "extractor", "large")], "id string, role string, profile string")
    profiles = spark.createDataFrame([("small", 2, 1500, 1, 400), ("large", 5, 9000, 2, 1500)], "profile_id string, core_rows int, core_size int, overlap_rows int, overlap_size int")
    return ensemble.plans(rows, chosen, profiles, "people", "size")


@query
def pass_agreement(spark, sf_dir):
    rows = adapted.candidate(spark, sf_dir).select(F.concat_ws("|", "title", "description").alias("candidate"), F.col("source_id").alias("pass_id"))
    return ensemble.agreement(rows, 2)


# More scalar functions -----------------------------------------------------------------------------------------------


@query
def attachment_totals(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "documents").selectExpr("concat('f', doc_id, CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '' END) AS name", "CAST(NULL AS STRING) AS mime", "n_chars AS size")
    return rows.agg(*normalize.attachment_totals(F.col("name"), F.col("mime"), F.col("size")))


@query
def sleep_and_mood(spark, sf_dir):
    return adapted.table(spark, sf_dir, "events").select("event_id", normalize.mood(F.col("event_id") % 7).alias("mood"), normalize.sleep_hours(F.col("value")).alias("hours"))


@query
def relative_labels(spark, sf_dir):
    return adapted.message(spark, sf_dir).select("id", claims.relative_label(F.col("captured_ts"), AS_OF).alias("label"))


@query
def search_radii(spark, sf_dir):
    rows = adapted.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey * 3.0D AS lat", "0.01D * (s_suppkey % 50) AS north", "0.02D * (s_suppkey % 30) AS east")
    return rows.select("s_suppkey", normalize.search_radius(F.col("lat"), F.lit(0.0), F.lit(0.0), F.col("north"), F.col("east")).alias("radius"))


@query
def claim_scores(spark, sf_dir):
    """Categories and scores of claims, some of which say what categories are known by."""
    rows = evidence.merged_claims(adapted.claim(spark, sf_dir), "person_id", "kind", "claim_key")
    stable = evidence.stability(F.col("n_sources"), F.col("first_ts"), F.col("last_ts"))
    phrases = F.array(*map(F.lit, ["", "不要再打扰", "喜欢爬山", "经常散步", "在学校工作", "一起吃饭", "擅长画画", "明天取件", "好的"]))
    text = F.concat(F.get(phrases, (F.col("score") % 9).cast("int")), "claim_key")
    of = claims.category(F.col("kind"), text, text)
    return rows.select("person_id", "kind", "claim_key", of.alias("category"), claims.score(F.col("kind"), text, text, stable, of).alias("score"))


@query
def task_atlas(spark, sf_dir):
    """Tasks by their category."""
    subjects = F.array(*map(F.lit, ["", "恋爱 ", "选课 ", "聚会 ", "作业 ", "医院 ", "系统: ", "WeChat：约会 "]))
    text = F.concat(F.get(subjects, F.length("content") % 8), "content")
    rows = adapted.message(spark, sf_dir).select("id", normalize.task_category(text, F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("category"), normalize.provider(text).alias("provider"))
    return rows.groupBy("category").agg(F.count("*").alias("tasks"), F.count("provider").alias("provided"))
