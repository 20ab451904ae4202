"""Browsing an archive of messages: indexes, summaries, search and pages. Messages: sources/adapted.py has their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import conversation_key, conversation_kind, cursor_of, month_of

PREVIEW = 420


def keyed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("key", conversation_key())


def in_order(at: str = "captured_ts", tie: str = "id") -> list[Column]:
    """By time, undated last, then by id."""
    return [F.col(at).asc_nulls_last(), F.col(tie).asc()]


def conversation_index(messages: DataFrame) -> DataFrame:
    """key, name, kind, source, messages, first_ts, last_ts, preview, speaker of every conversation.

    The preview is the latest message of the counterpart, else of anyone; name, kind and source are the first message's.
    All of it is one aggregation with partial sums, whatever the size of a conversation."""
    rows = keyed(messages).withColumn("place", F.struct(F.col("captured_ts").isNotNull().alias("dated"), "captured_ts", "id"))
    first = F.struct(F.col("captured_ts").isNull().alias("undated"), "captured_ts", "id")
    shown = F.struct(F.substring("content", 1, PREVIEW).alias("text"), "speaker")
    other = F.when(F.col("speaker_role") == "other", F.col("place"))
    out = rows.groupBy("key").agg(
        F.min_by("conversation_name", first).alias("name"),
        F.min_by(conversation_kind(), first).alias("kind"),
        F.min_by("source", first).alias("source"),
        F.count("*").alias("messages"),
        F.min("captured_ts").alias("first_ts"),
        F.max("captured_ts").alias("last_ts"),
        F.max_by(shown, other).alias("theirs"),
        F.max_by(shown, "place").alias("latest"),
    )
    picked = F.coalesce("theirs", "latest")
    return out.select("key", "name", "kind", "source", "messages", "first_ts", "last_ts", picked["text"].alias("preview"), picked["speaker"].alias("speaker"))


def recent_first(index: DataFrame, limit: int) -> DataFrame:
    """The first page of an index."""
    return index.orderBy(F.col("last_ts").desc_nulls_last(), "key").limit(limit)


def search(index: DataFrame, query: str) -> DataFrame:
    """Conversations whose name, key or source has the words, in any case."""
    return index.where(F.contains(F.lower(F.concat_ws("\n", "name", "key", "source")), F.lit(query.strip().lower())))


def index_page(index: DataFrame, after: tuple[str, str | None] | None, limit: int = 120) -> DataFrame:
    """The page behind the conversation `after` (key, last time as text): a predicate on the keys, not an offset."""
    if after is not None:
        key, last = after
        at = F.lit(last).cast("timestamp_ntz")
        later = F.col("last_ts").isNull() & (F.col("key") > key) if last is None else (F.col("last_ts") < at) | F.col("last_ts").isNull() | ((F.col("last_ts") == at) & (F.col("key") > key))
        index = index.where(later)
    return recent_first(index, limit).withColumn("cursor", cursor_of(F.col("key"), F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss")))


def conversation_page(messages: DataFrame, key: str, after: tuple[str, str | None] | None = None, limit: int = 200) -> DataFrame:
    """Messages of one conversation behind the message `after` (id, time as text)."""
    rows = keyed(messages).where(F.col("key") == key)
    if after is not None:
        id_, last = after
        at = F.lit(last).cast("timestamp_ntz")
        rows = rows.where(F.col("captured_ts").isNull() & (F.col("id") > id_) if last is None else (F.col("captured_ts") > at) | F.col("captured_ts").isNull() | ((F.col("captured_ts") == at) & (F.col("id") > id_)))
    return rows.orderBy(*in_order()).limit(limit)


def timeline(messages: DataFrame) -> DataFrame:
    """key, messages, first_ts, last_ts and the month under which a conversation is listed."""
    out = keyed(messages).groupBy("key").agg(F.count("*").alias("messages"), F.min("captured_ts").alias("first_ts"), F.max("captured_ts").alias("last_ts"))
    return out.withColumn("bucket", F.coalesce(month_of(F.col("last_ts")), F.lit("undated")))


def archive_summary(messages: DataFrame) -> DataFrame:
    """One row: messages, conversations with and without an id, and of which kind; an unknown kind yields to a known one."""
    kinds = keyed(messages).withColumn("identified", F.coalesce(F.col("conversation_id") != "", F.lit(False))).withColumn("own", conversation_kind())
    each = kinds.groupBy("key").agg(F.count("*").alias("n"), F.max("identified").alias("identified"), F.max(F.when(F.col("own") != "unknown", F.col("own"))).alias("own"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count_if("identified").alias("identified"),
        F.count_if(~F.col("identified")).alias("fallback"),
        F.count_if(F.col("own") == "direct").alias("direct"),
        F.count_if(F.col("own") == "group").alias("groups"),
        F.count_if(F.col("own").isNull()).alias("unknown"),
    )


def interaction_summary(messages: DataFrame, *by: str) -> DataFrame:
    """Distinct messages, their times, roles and conversations."""
    return keyed(messages).dropDuplicates(["id"]).groupBy(*by).agg(
        F.count("*").alias("messages"),
        F.min("captured_ts").alias("first_ts"),
        F.max("captured_ts").alias("last_ts"),
        *[F.count_if(F.col("speaker_role") == r).alias(f"n_{r}") for r in ("self", "other", "unknown")],
        F.count_distinct("key").alias("conversations"),
    )


def directions(messages: DataFrame) -> DataFrame:
    """Messages by conversation and role, a column each."""
    return keyed(messages).groupBy("key").agg(*[F.count_if(F.col("speaker_role") == r).alias(f"n_{r}") for r in ("self", "other", "unknown")])


def counterparts(messages: DataFrame) -> DataFrame:
    """key, speaker, n: who else speaks most in a conversation, of equals the first by name."""
    counts = keyed(messages).where((F.col("speaker_role") == "other") & F.col("speaker").isNotNull()).groupBy("key", "speaker").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "speaker")).alias("best")
    return counts.groupBy("key").agg(best).select("key", "best.speaker", (-F.col("best.less")).alias("n"))


def only_counterparts(messages: DataFrame, fallback: str) -> DataFrame:
    """key, speaker: the one other speaker, or the fallback if there is none or are several."""
    speaker = F.when(F.col("speaker_role") == "other", F.col("speaker"))
    return keyed(messages).groupBy("key").agg(F.when(F.count_distinct(speaker) == 1, F.min(speaker)).otherwise(F.lit(fallback)).alias("speaker"))


def dated_between(messages: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Messages of the days from first to last; undated ones only without bounds."""
    out = messages
    if first is not None:
        out = out.where(F.col("captured_ts") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        out = out.where(F.col("captured_ts") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return out


def touching(index: DataFrame, first: str, last: str) -> DataFrame:
    """Conversations whose span meets the days from first to last."""
    return index.where((F.col("first_ts") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")) & (F.col("last_ts") >= F.lit(first).cast("timestamp_ntz")))


def fallback_people(messages: DataFrame) -> DataFrame:
    """person, conversations, messages: a card for everyone with whom there are direct conversations."""
    direct = keyed(messages).withColumn("own", conversation_kind()).where(F.col("own") == "direct")
    named = counterparts(direct).select("key", F.col("speaker").alias("person"))
    sizes = direct.groupBy("key").agg(F.count("*").alias("n"))
    return named.join(sizes, "key").groupBy("person").agg(F.count("*").alias("conversations"), F.sum("n").alias("messages"))


def newest(rows: DataFrame, by: str, limit: int, *per: str) -> DataFrame:
    """The newest rows, undated last, of all or of each group."""
    if not per:
        return rows.orderBy(F.col(by).desc_nulls_last(), "id").limit(limit)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.col(by).desc_nulls_last(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)
