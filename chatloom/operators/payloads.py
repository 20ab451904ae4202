"""What goes to a model and whether it may: rows of a payload counted, cut and judged, none of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import fnv1a36, trimmed
from chatloom.operators.ensemble import clusters

CLAIMS, CLAIM_TEXT, CLAIM_QUOTE, CLAIM_SOURCES, NAME, NOTES = 96, 360, 120, 12, 120, 6000
SELF_ROWS, SELF_TEXT, SELF_SOURCES = 180, 600, 16
RECORD_ID, RECORD_TEXT, ATTACHMENTS, ATTACHMENT_SIZE = 160, 3000, 4, 16 * 1024 * 1024

# Kinds, categories, and keys of values that tell a place.
CATEGORIES = ("identity", "background", "preference", "habit", "boundary", "interaction", "skill", "temporary", "filler")
STABILITIES = ("single", "repeated", "persistent")
OBSERVATION_KINDS = ("event", "behavior", "emotional-state", "cognition", "relationship", "decision", "routine", "stressor", "coping", "change", "uncertainty")
VALUE_KEY, VALUE_TEXT, VALUES = r"^[a-zA-Z][a-zA-Z0-9_.-]{0,63}$", 800, 48
PLACE_KEY = r"(?i)(?:^|[_.-])(?:lat(?:itude)?|lng|lon(?:gitude)?|coord(?:inate)?s?|address|geohash)(?:$|[_.-])"
EVENT_KINDS = ("calendar", "location", "movement", "screen-time", "activity", "health", "payment", "device", "custom")


def _cut(column: str, most: int) -> Column:
    return F.substring(trimmed(F.coalesce(F.col(column), F.lit(""))), 1, most)


def _first(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` rows of each payload."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("payload").orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def checked(payloads: DataFrame, records: DataFrame, attachments: DataFrame) -> DataFrame:
    """payload, records, issue: the first rule that a payload breaks (null: none). payloads: payload, total, declared, segment,
    segments, core (array of places, null: all); records: payload, id, content, summary; attachments: payload, mime, size."""
    text = F.coalesce(F.when(_cut("content", RECORD_TEXT) != "", _cut("content", RECORD_TEXT)), _cut("summary", RECORD_TEXT))
    held = records.groupBy("payload").agg(F.count("*").alias("records"), F.count_if((_cut("id", RECORD_ID) == "") | (text == "")).alias("blank"))
    bad = F.coalesce(trimmed("mime") == "", F.lit(True)) | F.coalesce((F.col("size") <= 0) | (F.col("size") > ATTACHMENT_SIZE), F.lit(True))
    files = attachments.groupBy("payload").agg(F.count("*").alias("files"), F.count_if(bad).alias("bad_files"))
    rows = payloads.join(held, "payload", "left").join(files, "payload", "left").na.fill(0, ["records", "blank", "files", "bad_files"])
    n = F.col("records")
    numbered = F.col("segment").isNotNull() | F.col("segments").isNotNull()
    fits = F.coalesce((F.col("segment") >= 1) & (F.col("segments") >= F.col("segment")), F.lit(False))
    issue = (
        F.when(n == 0, "no-records")
        .when(F.col("total") < n, "total-too-small")
        .when(F.col("declared") != n, "not-all-records")
        .when(numbered & ~fits, "segment-number")
        .when(F.col("core").isNotNull() & ((F.size("core") == 0) | F.exists("core", lambda x: x.isNull() | (x < 1) | (x > n))), "core-places")
        .when(F.col("files") > ATTACHMENTS, "too-many-attachments")
        .when(F.col("blank") > 0, "record-without-id-or-text")
        .when(F.col("bad_files") > 0, "attachment")
    )
    return rows.select("payload", "records", issue.alias("issue"))


def merge_claims(claims: DataFrame) -> DataFrame:
    """The first CLAIMS claims of each payload, normalized; ones without text, quote or sources are left out. claims: payload, ord,
    id, kind, text, quote, source_ids, strength, category, stability, score, eligible, first_ts, last_ts."""
    sources = F.slice(F.array_distinct(F.filter(F.coalesce("source_ids", F.array().cast("array<string>")), lambda x: x != "")), 1, CLAIM_SOURCES)
    kind = F.when(F.col("kind").isin("preference", "event"), F.col("kind")).otherwise("fact")
    rows = claims.withColumns({"kind": kind, "text": _cut("text", CLAIM_TEXT), "quote": _cut("quote", CLAIM_QUOTE), "source_ids": sources})
    rows = rows.where((F.col("text") != "") & (F.col("quote") != "") & (F.size("source_ids") > 0))
    own = F.concat(F.lit("claim-"), fnv1a36(F.concat_ws("|", "kind", "text", "quote", F.array_join(F.array_sort("source_ids"), ","))))
    repeated = F.coalesce(F.col("strength") == "repeated", F.lit(False))
    rows = rows.withColumns({
        "id": F.when(_cut("id", RECORD_ID) != "", _cut("id", RECORD_ID)).otherwise(own),
        "strength": F.when(repeated, "repeated").otherwise("single"),
        "stability": F.when(F.col("stability").isin(*STABILITIES), F.col("stability")).when(repeated, "repeated").otherwise("single"),
        "eligible": F.coalesce("eligible", F.lit(True)) & ~F.coalesce(F.col("category").isin("temporary", "filler"), F.lit(False)),
        "category": F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("background"),
        "score": F.when(F.col("score").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), F.col("score")))),
    })
    return _first(rows, CLAIMS, "ord", "id")


def merge_payloads(people: DataFrame, claims: DataFrame) -> DataFrame:
    """payload, claims, ok: a payload may go if it has a name and a claim (of merge_claims), two facts, or notes. people: payload,
    name, facts, notes."""
    held = claims.groupBy("payload").agg(F.count("*").alias("claims"))
    facts = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("facts", F.array().cast("array<string>")), lambda x: F.substring(trimmed(x), 1, CLAIM_TEXT)), lambda x: x != "")))
    rows = people.join(held, "payload", "left").na.fill(0, ["claims"])
    ok = (_cut("name", NAME) != "") & ((F.col("claims") > 0) | (facts >= 2) | (_cut("notes", NOTES) != ""))
    return rows.select("payload", "claims", ok.alias("ok"))


def self_only(records: DataFrame) -> DataFrame:
    """payload, ok: whether all of a payload's records are by oneself."""
    return records.groupBy("payload").agg(F.bool_and(F.coalesce(F.col("speaker_role") == "self", F.lit(False))).alias("ok"))


def coarse_events(events: DataFrame) -> DataFrame:
    """The first SELF_ROWS events of each payload, without what tells a place: payload, ord, id, kind, title, summary, start_ts,
    end_ts and, if they have them, values (a map of texts: the first VALUES that are not blank, without keys that tell a place).
    Ones without id, start or title are left out; an end before the start is none."""
    kind = F.when(F.col("kind").isin(*EVENT_KINDS), F.col("kind")).otherwise("custom")
    place = F.coalesce(F.col("kind") == "location", F.lit(False))
    values = []
    if "values" in events.columns:
        kept = F.map_filter("values", lambda k, v: k.rlike(VALUE_KEY) & ~k.rlike(PLACE_KEY) & (trimmed(F.coalesce(v, F.lit(""))) != ""))
        kept = F.map_from_entries(F.slice(F.map_entries(F.transform_values(kept, lambda k, v: F.substring(trimmed(v), 1, VALUE_TEXT))), 1, VALUES))
        values = [F.when(F.size(kept) > 0, kept).alias("values")]
    rows = events.select(
        "payload", "ord", *values, _cut("id", RECORD_ID).alias("id"), kind.alias("kind"), "start_ts",
        F.when(F.col("end_ts") >= F.col("start_ts"), F.col("end_ts")).alias("end_ts"),
        F.when(place, "Location capture").otherwise(_cut("title", 240)).alias("title"),
        F.when(~place & (_cut("summary", 2400) != ""), _cut("summary", 2400)).alias("summary"),
    )
    return _first(rows.where("id <> '' AND start_ts IS NOT NULL AND title <> ''"), SELF_ROWS, "ord", "id")


def self_observations(observations: DataFrame) -> DataFrame:
    """The first SELF_ROWS whole observations of each payload: payload, ord, id, kind, text, source_ids, from_ts, to_ts."""
    sources = F.slice(F.array_distinct(F.filter(F.coalesce("source_ids", F.array().cast("array<string>")), lambda x: x != "")), 1, SELF_SOURCES)
    kind = F.when(F.col("kind").isin(*OBSERVATION_KINDS), F.col("kind")).otherwise("uncertainty")
    rows = observations.select("payload", "ord", _cut("id", RECORD_ID).alias("id"), kind.alias("kind"), _cut("text", SELF_TEXT).alias("text"), sources.alias("source_ids"), "from_ts", "to_ts")
    return _first(rows.where((F.col("id") != "") & (F.col("text") != "") & (F.size("source_ids") > 0) & F.col("from_ts").isNotNull() & F.col("to_ts").isNotNull()), SELF_ROWS, "ord", "id")


def judge_inputs(observations: DataFrame) -> DataFrame:
    """key, source_id, observations, participants, state: for the judge of each conversation, what its observations say of each
    cited message. observations: key, observation, participant, validation, source_id."""
    scoped = observations.withColumn("source_id", F.when(F.col("source_id") != "", F.concat_ws("\u001f", "key", "source_id")))
    return clusters(scoped).select(F.split_part("source_id", F.lit("\u001f"), F.lit(1)).alias("key"), F.split_part("source_id", F.lit("\u001f"), F.lit(2)).alias("source_id"), "observations", "participants", "state")
