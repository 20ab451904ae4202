"""Candidates and what becomes of them: checked, compared with those there are, made tasks or dismissed; and lists of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import blank_as_null, fnv1a36, trimmed
from chatloom.operators.links import name_matches, names_containing
from chatloom.operators.merge import SAID, conflicts, keyed
from chatloom.operators.segments import placed
from chatloom.sources.staging import staged

# Limits and marks.
TITLE, DESCRIPTION, SOURCES, PEOPLE, TAGS, GUIDANCE, PLACE, TIME = 120, 1000, 30, 12, 10, 3, 120, 40
RADIUS = (50, 100_000)
TASK_ID, CANDIDATE_TAG, TASK_TAGS = "q-ai-", "模型候选", 8


def with_owner(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """candidates (id, action_owner, source_ids) whose owner is not told become one's own if they cite a message of one's own."""
    cited = candidates.where("action_owner IS NULL").select("id", F.explode("source_ids").alias("source_id"))
    own = messages.where("speaker_role = 'self'").select(F.col("id").alias("source_id"))
    mine = cited.join(own, "source_id", "left_semi").select("id").distinct().withColumn("mine", F.lit(True))
    return candidates.join(mine, "id", "left").withColumn("action_owner", F.when(F.col("mine") & F.col("action_owner").isNull(), "self").otherwise(F.col("action_owner"))).drop("mine")


def _trimmed(array: str, most: int) -> Column:
    return F.slice(F.filter(F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x: trimmed(x)), lambda x: x != ""), 1, most)


def normalized(candidates: DataFrame) -> DataFrame:
    """Candidates of one's own with a title, a description and sources, cut to their limits; the id is a hash of these."""
    rows = candidates.where("action_owner = 'self'").withColumn("title", F.substring(trimmed("title"), 1, TITLE)).withColumn("description", F.substring(trimmed("description"), 1, DESCRIPTION))
    rows = rows.withColumn("source_ids", F.slice("source_ids", 1, SOURCES)).where("title <> '' AND description <> '' AND size(source_ids) > 0")
    key = F.concat_ws("|", "title", "description", F.array_join("source_ids", ","))
    radius = F.when(F.col("radius") > 0, F.greatest(F.lit(RADIUS[0]), F.least(F.lit(RADIUS[1]), F.floor(F.col("radius") + 0.5)))).cast("long")
    return rows.select(
        F.concat(F.lit("ai-"), fnv1a36(key), F.lit("-"), F.col("nth").cast("string")).alias("id"),
        "title",
        "description",
        "source_ids",
        _trimmed("people", PEOPLE).alias("people"),
        _trimmed("tags", TAGS).alias("tags"),
        F.substring(blank_as_null(trimmed("place")), 1, PLACE).alias("place"),
        F.when(F.col("location_precision").isin("exact", "approximate", "unknown"), F.col("location_precision")).alias("location_precision"),
        radius.alias("radius"),
        F.lit("pending").alias("status"),
    )


def not_known_yet(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming candidates (id, title, description, source_id, start_at, place, location_precision) that equal no existing one.

    Three anti-joins by keys, as of `merge.duplicate_pairs`; of existing ones that no comparison tells apart, one is asked."""
    left = keyed(incoming).withColumn("a", F.struct(*SAID))
    known = staged(keyed(existing).select("source_id", "t", "d", *SAID), "existing_candidates")
    for keys in (["t", "d"], ["source_id", "t"], ["source_id", "d"]):
        others = known.select(*keys, *SAID).distinct().select(*[F.col(k).alias(f"other_{k}") for k in keys], F.struct(*SAID).alias("b"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"other_{k}"))
        left = left.join(others, same & ~F.coalesce(conflicts("a", "b"), F.lit(False)), "left_anti")
    return left.drop("t", "d", "p", "a")


def tasks_of(candidates: DataFrame, tasks: DataFrame, places: DataFrame, people: DataFrame) -> DataFrame:
    """Tasks from pending candidates (id, title, place, people, tags, source_ids, status) that are not tasks (id) yet. A task is
    at the first place (place_id, name) whose name holds the candidate's or is held by it, and with all people (person, name) so named."""
    new = candidates.where("status = 'pending'").withColumn("task", F.concat(F.lit(TASK_ID), "id")).join(tasks.select(F.col("id").alias("task")), "task", "left_anti")
    at = name_matches(new.select(F.col("place").alias("asked")), places.select(F.col("name").alias("at_place"), "place_id"), "asked", "at_place", "place_id")
    named = new.select("task", F.explode("people").alias("asked"))
    met = names_containing(named.select("asked"), people.select(F.col("name").alias("known"), "person"), "asked", "known")
    who = named.join(met, "asked").groupBy("task").agg(F.array_sort(F.collect_set("person")).alias("characters"))
    out = new.join(at.select("asked", "place_id"), F.col("place") == F.col("asked"), "left").join(who, "task", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("task").alias("id"), "title", F.lit("available").alias("status"), F.col("place_id").alias("location_id"), F.coalesce("characters", none).alias("characters"), F.slice(F.concat(F.array(F.lit(CANDIDATE_TAG)), "tags"), 1, TASK_TAGS).alias("tags"), "source_ids")


def reviewed(messages: DataFrame, created: DataFrame) -> DataFrame:
    """messages, reviewed where a created task cites them."""
    cited = created.select(F.explode("source_ids").alias("id")).distinct().withColumn("cited", F.lit(True))
    return messages.join(cited, "id", "left").withColumn("status", F.when(F.col("cited"), "reviewed").otherwise(F.col("status"))).drop("cited")


def dismissed(candidates: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidates (id, status), dismissed where there is a reason (id, reason), and a row of feedback for each of those."""
    marked = candidates.join(reasons.select("id", "reason"), "id", "left")
    rows = marked.withColumn("status", F.when(F.col("reason").isNotNull(), "dismissed").otherwise(F.col("status"))).drop("reason")
    return rows, marked.where("reason IS NOT NULL").select("id", F.lit("dismissed").alias("decision"), "reason")


def evidence_restored(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """tasks (id, source_ids, source_at) with the sources and the time of the candidate (id, source_ids, source_at, created_at) that they were made of, where they have none."""
    made = candidates.select(F.concat(F.lit(TASK_ID), "id").alias("id"), F.col("source_ids").alias("were"), F.coalesce("source_at", "created_at").alias("was_at"))
    rows = tasks.join(made, "id", "left")
    some = F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.col("were"))
    at = F.when(F.coalesce(F.size(some), F.lit(0)) > 0, F.coalesce("source_at", "was_at")).otherwise(F.col("source_at"))
    return rows.withColumn("source_at", at).withColumn("source_ids", some).drop("were", "was_at")


def source_times(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """id, source_at: the latest time of the messages that a task cites, else the one that it holds."""
    cited = tasks.select("id", F.explode("source_ids").alias("source_id")).join(messages.select(F.col("id").alias("source_id"), "captured_ts"), "source_id")
    last = cited.groupBy("id").agg(F.max("captured_ts").alias("last"))
    return tasks.join(last, "id", "left").select("id", F.coalesce("last", "source_at").alias("source_at"))


def place_removed(tasks: DataFrame, places: DataFrame, place_id: int) -> DataFrame:
    """tasks after a place is deleted: its tasks go to the first place left; the last place cannot be deleted."""
    left = places.agg(F.min(F.when(F.col("place_id") != place_id, F.col("place_id"))).alias("first"), F.bool_or(F.col("place_id") == place_id).alias("was")).first()
    if left["first"] is None or not left["was"]:
        return tasks
    return tasks.withColumn("location_id", F.when(F.col("location_id") == place_id, left["first"]).otherwise(F.col("location_id")))


def generated_places(candidates: DataFrame, places: DataFrame, lookups: DataFrame) -> DataFrame:
    """id, place_id, found: a candidate's place among those there are, else what its name was looked up as (query, found)."""
    asked = candidates.where(blank_as_null(trimmed("place")).isNotNull()).select("id", trimmed("place").alias("query"))
    near = name_matches(asked.select("query"), places.select(F.col("name").alias("at_place"), "place_id"), "query", "at_place", "place_id").select("query", "place_id")
    known = lookups.dropDuplicates(["query"])
    return candidates.select("id").join(asked, "id", "left").join(near, "query", "left").join(known, "query", "left").select("id", "place_id", F.when(F.col("place_id").isNull(), F.col("found")).alias("found"))


def listed(tasks: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Tasks of a status that hold a text, by time and title; undated ones are last."""
    rows = tasks if status is None else tasks.where(F.col("status") == status)
    rows = rows.where(F.contains(F.lower("title"), F.lit(text.lower()))) if text else rows
    return rows.orderBy(F.col("start_ts").asc_nulls_last(), "title", "id")


def by_day(tasks: DataFrame) -> DataFrame:
    """day, tasks, first_id: tasks by day in their order; long events are a group of their own, undated ones another."""
    day = F.when(F.col("long"), "long").otherwise(F.coalesce(F.date_format("start_ts", "yyyy-MM-dd"), F.lit("undated")))
    return tasks.groupBy(day.alias("day")).agg(F.count("*").alias("tasks"), F.min_by("id", F.struct(F.col("start_ts").isNull(), "start_ts", "title", "id")).alias("first_id"))


def atlas(tasks: DataFrame, category: str) -> DataFrame:
    """tasks with their place in their category: by hand, then those to do, then by title. Numbered by sorted ranges."""
    return placed(tasks, category, [F.col("atlas_order").asc_nulls_last(), F.col("status") == "done", F.col("title"), F.col("id")])


def rearranged(tasks: DataFrame, orders: DataFrame) -> DataFrame:
    """tasks with the category and order that lists of ids (category, ids, first: which list wins) give them."""
    each = orders.select("category", "first", F.posexplode("ids").alias("pos", "id"))
    last = each.groupBy("id").agg(F.min_by(F.struct("category", "pos"), F.struct("first", (-F.col("pos")).alias("late"))).alias("to"))
    rows = tasks.join(last, "id", "left")
    return rows.withColumn("category", F.coalesce("to.category", "category")).withColumn("atlas_order", F.coalesce("to.pos", "atlas_order")).drop("to")


def overview(tasks: DataFrame, people: DataFrame, checkins: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = {
        "active": tasks.where(F.col("status").isin("active", "available")).agg(F.count("*").alias("n")),
        "done": tasks.where("status = 'done'").agg(F.count("*").alias("n")),
        "people": people.agg(F.count("*").alias("n")),
        "checkins": checkins.agg(F.count("*").alias("n")),
        "messages": messages.agg(F.count("*").alias("n")),
        "conversations": messages.agg(F.count_distinct("key").alias("n")),
    }
    rows = None
    for name, one in counts.items():
        part = one.select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionAll(part)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts])


def due(mode: Column, time_due: Column, pending: Column, least: Column) -> Column:
    """Whether an automatic run is due: by time, by the number of messages, or by either."""
    many = pending >= F.greatest(F.lit(1), F.coalesce(F.when(least != 0, least), F.lit(50)))
    return F.when(mode == "time", time_due).when(mode == "message-count", many).otherwise(time_due | many)


def may_consolidate(paused: Column, extracting: Column, scheduled: Column) -> Column:
    return ~paused & ~extracting & ~scheduled


def remote_is_fresher(expected: Column, local_print: Column, local_at: Column, has_local: Column, remote_print: Column, remote_at: Column) -> Column:
    """Whether a remote snapshot is to be loaded: the one with the expected fingerprint first, then the later one; never by count."""
    ours, theirs = F.coalesce(local_print == expected, F.lit(False)), F.coalesce(remote_print == expected, F.lit(False))
    return F.when(remote_at.isNull(), False).when(~has_local, True).when(theirs & ~ours, True).when(theirs != ours, False).when(local_at.isNull(), True).otherwise(remote_at > local_at)
