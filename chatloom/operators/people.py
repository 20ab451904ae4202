"""People in conversations: who is meant, what is dismissed, and what observations become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import fnv1a36, text_key
from chatloom.operators.evidence import scope


def counterpart_rows(messages: DataFrame, names: DataFrame) -> DataFrame:
    """id, key, basis: the messages that a returned name stands for. Messages of a speaker of that name; or all of the other
    side's, if none of them names a speaker and the conversation is expected to be with that name. names: key, returned, expected."""
    others = messages.where("speaker_role = 'other'").withColumn("who", text_key(F.coalesce("speaker", F.lit(""))))
    sides = others.groupBy("key").agg(F.count_if(F.col("who") != "").alias("named"))
    asked = names.withColumn("who", text_key(F.col("returned"))).withColumn("due", text_key(F.coalesce("expected", F.lit("")))).where("who <> ''")
    by_name = others.join(asked.select("key", "who"), ["key", "who"], "left_semi").select("id", "key", F.lit("speaker").alias("basis"))
    nameless = asked.where("who = due").join(sides.where("named = 0"), "key", "left_semi").select("key")
    return by_name.unionAll(others.join(nameless, "key", "left_semi").select("id", "key", F.lit("conversation").alias("basis")))


def not_dismissed(people: DataFrame, dismissed: DataFrame) -> DataFrame:
    """people (id, keys) none of whose conversations is dismissed (key)."""
    hidden = people.select("id", F.explode("keys").alias("key")).join(dismissed.select("key").distinct(), "key", "left_semi").select("id").distinct()
    return people.join(hidden, "id", "left_anti")


def removed(people: DataFrame, tasks: DataFrame, dismissed: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """people, tasks (id, people) and dismissed (key) after the people of `gone` (id) are deleted."""
    ids = gone.select("id").distinct()
    edges = tasks.select("id", F.explode("people").alias("person")).join(ids.withColumnRenamed("id", "person"), "person", "left_semi").groupBy("id").agg(F.collect_set("person").alias("out"))
    kept = tasks.join(edges, "id", "left").withColumn("people", F.when(F.col("out").isNull(), F.col("people")).otherwise(F.array_except("people", "out"))).drop("out")
    keys = people.join(ids, "id", "left_semi").select(F.explode("keys").alias("key"))
    return people.join(ids, "id", "left_anti"), kept, dismissed.select("key").union(keys).distinct()


def observation_id(kind: str, text: str, evidence: str):
    """The id of an observation by its kind, text and evidence (an array of structs source_id, quote)."""
    parts = F.array_join(F.array_sort(F.transform(evidence, lambda e: F.concat(e["source_id"], F.lit(":"), F.regexp_replace(e["quote"], r"\s+", "")))), "|")
    return F.concat(F.lit("self-observation-"), fnv1a36(F.concat(F.col(kind), F.lit("\0"), text_key(F.col(text)), F.lit("\0"), parts)))


def merged_observations(observations: DataFrame) -> DataFrame:
    """One row an id: its distinct evidence, and the first and last time. observations: id, source_id, quote, from_ts, to_ts."""
    return observations.groupBy("id").agg(
        F.count_distinct("source_id", "quote").alias("evidence"),
        F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        F.min("from_ts").alias("from_ts"),
        F.max("to_ts").alias("to_ts"),
    )


def block_times(claims: DataFrame, as_of: str, *by: str) -> DataFrame:
    """The scope of a block of claims and its span: recent and historical claims together are a change."""
    rows = claims.withColumn("scope", scope(F.col("observed_ts"), as_of))
    has = {s: F.bool_or(F.col("scope") == s) for s in ("recent", "historical")}
    told = F.when(has["recent"] & has["historical"], "change").when(has["recent"], "recent").when(has["historical"], "historical").otherwise("undated")
    return rows.groupBy(*by).agg(told.alias("scope"), F.min("observed_ts").alias("from_ts"), F.max("observed_ts").alias("to_ts"))


def coverage(claims: DataFrame, *by: str) -> DataFrame:
    """Distinct claims, sources and kinds, and the span."""
    return claims.groupBy(*by).agg(
        F.count_distinct("kind", "claim_key").alias("claims"),
        F.count_distinct("source_id").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.min("observed_ts").alias("from_ts"),
        F.max("observed_ts").alias("to_ts"),
    )


def last_known(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each group in that order; of equals the later id."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(*by, *[F.col(f"x.{c}").alias(c) for c in others])


def carried_over(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key: what the new row says, and where it says nothing, the old one."""
    names = [c for c in old.columns if c != key]
    a, b = old.select(key, *[F.col(c).alias(f"old_{c}") for c in names]), new.select(key, *[F.col(c).alias(f"new_{c}") for c in names])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in names])
