"""Messages as models see them, references back to them, and what is told about oneself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.claims import not_clinical
from chatloom.functions.columns import blank_as_null, trimmed
from chatloom.operators.segments import placed, segments

# Limits, labels and names that readers see.
CONTENT, JOURNAL, TITLE, SUMMARY = 3000, 8000, 40, 1200
NO_TEXT = "[non-text message]"
UNNAMED = "未命名人物"
SNAPSHOT, SNAPSHOT_TITLE = "[每日状态快照]", " 状态快照"
MOOD, SLEEP, HOURS, MEDICATION, ALCOHOL, FOCUS, NOTE = "状态：", "睡眠：", " 小时", "药物：", "酒精：", "主要在做：", "一句话："
MEDICATIONS = {"yes": "是", "no": "否", "reduced": "减量", "unknown": "未记录"}
ALCOHOLS = {"none": "无", "low": "少", "high": "多", "unknown": "未记录"}


def model_text(*texts: Column) -> Column:
    """The first text that is not blank, trimmed and cut; a placeholder, as a row without text keeps its place."""
    return F.coalesce(F.substring(F.coalesce(*[blank_as_null(trimmed(t)) for t in texts]), 1, CONTENT), F.lit(NO_TEXT))


def known_role(role: Column) -> Column:
    return F.when(role.isin("self", "other"), role).otherwise("unknown")


def referenced(messages: DataFrame, key: str, order: list) -> DataFrame:
    """messages with `ref`, their number from 1 in the order of their conversation, as text. Numbered by sorted ranges."""
    return placed(messages, key, order).withColumn("ref", (F.col("place") + 1).cast("string")).drop("place")


def restored(entries: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """entries (entry, key, refs) with ids for the references that their conversation has; others stay as they are."""
    each = entries.select("entry", key, F.posexplode("refs").alias("pos", "ref"))
    met = each.join(numbered.select(key, "ref", F.col("id").alias("found")), [key, "ref"], "left")
    back = met.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("found", "ref").alias("id")))).alias("ids"))
    none = F.array().cast("array<string>")
    return entries.join(back, "entry", "left").select("entry", key, F.coalesce(F.transform("ids", lambda x: x["id"]), none).alias("source_ids"))


def self_records(messages: DataFrame) -> DataFrame:
    """The rows that analysis of oneself takes; their order is (captured_ts, id)."""
    return messages.where("speaker_role = 'self'").select("id", "captured_ts", "content", "conversation_id", "conversation_name", "source")


def self_plan(records: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """All records cut as one conversation: records with their place and segment. One key, dealt in blocks of ranges."""
    rows = records.withColumn("target", F.lit("self")).withColumn("size", (F.length("content") + F.length("id")).cast("long"))
    return segments(placed(rows, "target", [F.col("captured_ts").asc_nulls_last(), F.col("id")]), "target", "size", **budgets)


def verified_observations(observations: DataFrame, messages: DataFrame, core: DataFrame) -> DataFrame:
    """Observations (observation, kind, text, evidence: an array of source_id, quote) that messages of one's own bear out, one of them core (id)."""
    quote = F.substring(trimmed("e.quote"), 1, 180)
    told = observations.withColumn("text", not_clinical(F.col("text"), 600)).where("text <> ''")
    cited = told.select("observation", F.explode("evidence").alias("e")).select("observation", F.col("e.source_id").alias("id"), quote.alias("quote")).where(F.length("quote") >= 2).distinct()
    own = messages.where("speaker_role = 'self'").select("id", "content", "captured_ts")
    found = cited.join(own, "id").where(F.contains("content", "quote")).join(core.select("id", F.lit(True).alias("core")).distinct(), "id", "left")
    ok = found.groupBy("observation").agg(
        F.count("*").alias("evidence"),
        F.array_sort(F.collect_set("id")).alias("source_ids"),
        F.min("captured_ts").alias("from_ts"),
        F.max("captured_ts").alias("to_ts"),
        F.bool_or(F.coalesce("core", F.lit(False))).alias("core"),
    )
    return told.drop("evidence").join(ok.where("core AND from_ts IS NOT NULL").drop("core"), "observation")


def resolved_periods(paragraphs: DataFrame, observations: DataFrame) -> DataFrame:
    """Periods from paragraphs (period, paragraph, text, observation_ids): a paragraph stays with the observations that are known, at most 120 of them, if it has any."""
    text = not_clinical(F.col("text"), 1200)
    each = paragraphs.where(text != "").select("period", "paragraph", F.posexplode(F.array_distinct("observation_ids")).alias("pos", "observation"))
    known = each.join(observations.select("observation", "from_ts", "to_ts"), "observation")
    # a paragraph's observations came as one array, so their number is that of an array
    first = known.groupBy("period", "paragraph").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "observation", "from_ts", "to_ts"))), 1, 120).alias("kept"))
    kept = first.select("period", "paragraph", F.explode("kept").alias("k"))
    return kept.groupBy("period").agg(
        F.count_distinct("paragraph").alias("paragraphs"), F.count_distinct("k.observation").alias("observations"), F.min("k.from_ts").alias("from_ts"), F.max_by("k.to_ts", F.struct("k.from_ts", "k.to_ts")).alias("to_ts")
    )


def journal_rows(entries: DataFrame) -> DataFrame:
    """Journal entries (entry, name, content, at) as messages; blank ones are none."""
    body = F.substring(trimmed("content"), 1, JOURNAL)
    rows = entries.withColumn("content", body).where("content <> ''")
    title = F.when(F.length("content") > TITLE, F.concat(F.substring("content", 1, TITLE), F.lit("..."))).otherwise(F.col("content"))
    return rows.select(F.concat(F.lit("self-journal-"), "entry").alias("id"), title.alias("title"), F.substring("content", 1, SUMMARY).alias("summary"), "content", F.col("name").alias("speaker"), F.lit("self").alias("speaker_role"), F.lit("journal").alias("message_type"), F.col("at").alias("captured_ts"))


def _label(value: Column, labels: dict[str, str]) -> Column:
    out = F.lit(labels["unknown"])
    for name, label in labels.items():
        out = F.when(value == name, label).otherwise(out)
    return out


def checkin_rows(checkins: DataFrame) -> DataFrame:
    """Check-ins (date, mood, sleep, medication, alcohol, focus, note) as messages, one a date, at its noon."""

    def line(label: str, value: Column, after: str = "") -> Column:
        return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(label), value.cast("string"), F.lit(after)))

    text = F.concat_ws(
        "\n",
        F.lit(SNAPSHOT),
        line(MOOD, F.col("mood"), "/5"),
        line(SLEEP, F.col("sleep"), HOURS),
        F.concat(F.lit(MEDICATION), _label(F.col("medication"), MEDICATIONS)),
        F.concat(F.lit(ALCOHOL), _label(F.col("alcohol"), ALCOHOLS)),
        line(FOCUS, F.col("focus")),
        line(NOTE, F.col("note")),
    )
    return checkins.select(F.concat(F.lit("checkin-"), "date").alias("id"), F.concat("date", F.lit(SNAPSHOT_TITLE)).alias("title"), text.alias("content"), F.concat("date", F.lit("T12:00:00")).alias("captured_at"), F.lit("self").alias("speaker_role"), F.lit("daily-checkin").alias("message_type"))


def person_summaries(people: DataFrame, claims: DataFrame) -> DataFrame:
    """id, name, last_ts, portrait, facts, preferences: people (person, name, last_ts, portrait) in short, with how many of their
    claims (person, kind) are facts and preferences."""
    counts = claims.groupBy("person").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("fact", "facts"), ("preference", "preferences"))])
    name, portrait = (F.substring(trimmed(F.coalesce(c, F.lit(""))), 1, n) for c, n in (("name", 160), ("portrait", 480)))
    rows = people.join(counts, "person", "left").na.fill(0, ["facts", "preferences"])
    return rows.select(F.col("person").alias("id"), F.when(name != "", name).otherwise(UNNAMED).alias("name"), "last_ts", portrait.alias("portrait"), "facts", "preferences")
