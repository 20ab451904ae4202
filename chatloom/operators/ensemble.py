"""Several models over the same conversations: who reads what, and where they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import conversation_kind
from chatloom.operators import segments


def passes(participants: DataFrame, workflow: str, most: int) -> DataFrame:
    """The first `most` enabled extractors of a workflow in their order, and its first judge. participants: ord, id, role
    (extractor or judge), workflow, enabled, profile."""
    rows = participants.where(F.col("enabled") & (F.col("workflow") == workflow) & F.col("role").isin("extractor", "judge"))
    nth = F.row_number().over(Window.partitionBy("role").orderBy("ord"))
    return rows.withColumn("nth", nth).where(F.when(F.col("role") == "judge", F.col("nth") == 1).otherwise(F.col("nth") <= most))


def plans(messages: DataFrame, chosen: DataFrame, profiles: DataFrame, workflow: str, size: str) -> DataFrame:
    """participant, key, segment, rows, overlap: a cut of every conversation for each extractor, with its profile's budgets;
    only direct conversations for people. messages: key, place, size. Profiles are the user's settings, a few rows."""
    rows = messages
    if workflow == "people":
        direct = messages.withColumn("own", conversation_kind()).groupBy("key").agg(F.min_by("own", "place").alias("own")).where("own = 'direct'")
        rows = messages.join(direct.select("key"), "key", "left_semi")
    extractors = chosen.where("role = 'extractor'").join(profiles, F.col("profile") == profiles["profile_id"]).select("id", "core_rows", "core_size", "overlap_rows", "overlap_size").collect()
    out = None
    for e in extractors:
        budget = e.asDict()
        participant = budget.pop("id")
        cut = segments.segments(rows, "key", size, **budget)
        each = cut.groupBy("key", "segment").agg(F.count("*").alias("rows")).join(segments.overlaps(cut, "key", size, **budget), ["key", "segment"])
        part = each.select(F.lit(participant).alias("participant"), "key", "segment", "rows", "overlap")
        out = part if out is None else out.unionAll(part)
    return out


def clusters(observations: DataFrame) -> DataFrame:
    """By cited message: observations, participants and a state. All rejected: rejected; one in doubt: needs-review; two
    participants: corroborated; else single-source. observations: observation, participant, validation, source_id."""
    out = observations.where("source_id <> '' AND observation <> '' AND participant <> ''").groupBy("source_id").agg(
        F.count_distinct("observation").alias("observations"),
        F.count_distinct("participant").alias("participants"),
        F.bool_and(F.col("validation") == "rejected").alias("out"),
        F.bool_or(F.col("validation") == "needs-review").alias("doubt"),
    )
    state = F.when(F.col("out"), "rejected").when(F.col("doubt"), "needs-review").when(F.col("participants") >= 2, "corroborated").otherwise("single-source")
    return out.select("source_id", "observations", "participants", state.alias("state"))


def agreement(members: DataFrame, extractors: int) -> DataFrame:
    """candidate, passes, agreement of merged candidates. members: candidate, pass_id."""
    told = F.lit("single") if extractors <= 1 else F.when(F.col("passes") >= 2, "consensus").otherwise("needs-review")
    return members.groupBy("candidate").agg(F.count_distinct("pass_id").alias("passes")).withColumn("agreement", told)
