"""Advice about tasks: what it depends on, whether it is still due, whether it may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import trimmed

# Wordings of advice that manipulates or claims to know another's feelings.
RISKS = (
    "(?i)拿捏|操控|控制对方|欲擒故纵|故意冷落|冷处理|制造焦虑|制造嫉妒|让(?:她|他|对方)吃醋|试探底线|施压|逼迫|道德绑架|套路|套话|PUA",
    "(?:对方|她|他).{0,16}(?:一定|肯定|显然|必然).{0,12}(?:喜欢你|爱你|对你有意思|在意你)",
)


def risk(advice: Column) -> Column:
    """empty, manipulative-or-overconfident, or null for advice that may be shown."""
    text = trimmed(F.regexp_replace(F.coalesce(advice, F.lit("")), r"\s+", " "))
    return F.when(text == "", "empty").when(text.rlike(RISKS[0]) | text.rlike(RISKS[1]), "manipulative-or-overconfident")


def signatures(tasks: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """id, signature: changes with a task, its place and its people. tasks: id, title, description, start_at, due_at, location_id,
    people (ids); people: person, portrait, notes, facts; places: place_id, name, lat, lon, note."""
    told = people.select("person", F.sha2(F.to_json(F.struct("person", "facts", "portrait", "notes"), {"ignoreNullFields": "false"}), 256).alias("told"))
    linked = tasks.select("id", F.explode(F.array_distinct("people")).alias("person")).join(told, "person")
    # a task's people came as one array
    linked = linked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("person", "told"))), lambda x: x["told"]), ",").alias("linked"))
    where = places.select(F.col("place_id").alias("location_id"), F.concat_ws("\u001f", F.col("place_id").cast("string"), "name", F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce("note", F.lit(""))).alias("place"))
    rows = tasks.join(linked, "id", "left").join(where, "location_id", "left")
    own = F.concat_ws("\u001f", "id", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "start_at", "due_at")], F.array_join(F.array_sort(F.array_distinct("people")), ","))
    return rows.select("id", F.sha2(F.concat_ws("\u001e", own, F.coalesce("place", F.lit("")), F.coalesce("linked", F.lit(""))), 256).alias("signature"))


def current(answers: DataFrame, tasks: DataFrame, now: DataFrame) -> DataFrame:
    """Answers (id, people, signature) that came in time: their task is still there, has the people that it had, and its signature
    (now: id, signature) is that of the question."""
    there = tasks.select("id", F.array_sort(F.array_distinct("people")).alias("people_now")).join(now.select("id", F.col("signature").alias("signature_now")), "id")
    same = (F.array_sort(F.array_distinct("people")) == F.col("people_now")) & (F.col("signature") == F.col("signature_now"))
    return answers.join(there, "id").where(same).drop("people_now", "signature_now")
