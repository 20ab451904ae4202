"""Immutable batch documents of an archive's producers: chat batches and device snapshots, checked and made into rows.

Who produces them is the caller's to say (`Envelope`). Everything is JSON functions over the documents' text, so the same
code serves a batch of files and a stream of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import blank_as_null, trimmed

MOST = 10_000
#: The kinds of device events, and the keys that are kept of an event's values.
KINDS = "calendar location movement screen-time activity health payment device custom".split()
VALUE_KEY, MOST_VALUES = r"^[a-zA-Z][a-zA-Z0-9_.-]{0,63}$", 48
MODES, PLATFORMS = ("manual", "foreground", "background"), ("android", "windows")


@dataclass(frozen=True)
class Envelope:
    """What a document must say of itself."""

    schema: str
    producer: str
    layout: str
    #: What ids of the producer's rows begin with, before the account.
    prefix: str = ""


#: A row of another shape is null and takes no part; the others of its document stay.
_RECORD = "struct<id:string,title:string,summary:string,content:string,capturedAt:string,conversationId:string,conversationName:string,conversationKind:string,speaker:string,speakerRole:string,messageType:string,avatarId:string>"
CHAT = "schema string, generatedAt string, producer struct<name:string,version:string,layout:string>, account struct<id:string>, records array<string>, deleteIds array<string>"
_EVENT = "struct<id:string,source:string,kind:string,startAt:string,endAt:string,title:string,summary:string,capturedAt:string,privacy:string,values:map<string,string>,location:struct<latitude:double,longitude:double,accuracyMeters:double>,locationConsent:struct<exactLocation:boolean,captureMode:string,grantedAt:string>>"
SNAPSHOT = "schema string, generatedAt string, producer struct<name:string,version:string,layout:string>, device struct<platform:string>, events array<string>"


def cut(text: Column, most: int) -> Column:
    """A text without white space at its ends, of at most so many characters. It is blank only if it is empty."""
    return F.substring(trimmed(F.replace(text, F.lit("\r\n"), F.lit("\n"))), 1, most)


def clean(text: Column, most: int) -> Column:
    return blank_as_null(cut(text, most))


def iso(text: Column) -> Column:
    """UTC with milliseconds; null if it is no time."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(cut(text, 64)).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """The fields of the struct that `made` makes of a value, as columns of a row each. The value is worked out once: a filter on these
    columns stays above the generator, while one on plain columns is pushed below them and works out again what they are made of."""
    return F.inline(F.transform(F.array(value), made))


def opened(documents: DataFrame, schema: str, envelope: Envelope) -> DataFrame:
    """source_file, doc and whether the envelope holds. documents: source_file, value."""

    def told(doc: Column) -> Column:
        right = (doc["schema"] == envelope.schema) & (doc["producer"]["name"] == envelope.producer) & (doc["producer"]["layout"] == envelope.layout) & clean(doc["producer"]["version"], 64).isNotNull()
        return F.struct(doc.alias("doc"), F.coalesce(right, F.lit(False)).alias("ok"))

    return documents.select("source_file", once(F.from_json("value", schema), told))


def listed_in(rows: DataFrame, field: str, **told: Callable[[Column], Column]) -> DataFrame:
    """source_file, what is told of the document, pos and raw: a row for each entry of a document's array.

    Everything is put into the entries before they are rows. What stood beside an array that is exploded would be made for every row of
    it, from the document's whole text, so a document would cost the square of its entries."""
    each = F.transform(F.array("doc"), lambda doc: F.transform(F.array(F.struct(*[made(doc).alias(name) for name, made in told.items()])), lambda t: F.transform(doc[field], lambda raw, pos: F.struct(F.col("source_file").alias("source_file"), *[t[name].alias(name) for name in told], pos.alias("pos"), raw.alias("raw")))))
    return rows.select(F.inline(F.flatten(F.flatten(each))))


def _chat_entries(documents: DataFrame, envelope: Envelope, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages as documents list them (with pos), deletes as they list them (source_file, id) but of other accounts, and rejected documents."""
    rows = opened(documents, CHAT, envelope)
    sizes = (F.size("doc.records") >= 0) & (F.size("doc.records") <= MOST) & (F.coalesce(F.size("doc.deleteIds"), F.lit(0)) <= MOST)
    account = lambda doc: clean(doc["account"]["id"], 180)
    rows = rows.withColumn("ok", F.col("ok") & sizes & account(F.col("doc")).isNotNull())
    each = listed_in(rows.where("ok"), "records", account=account)
    texts = {"id": ("id", 420), "conversation_id": ("conversationId", 420), "conversation_name": ("conversationName", 240), "speaker": ("speaker", 160), "message_type": ("messageType", 80), "content": ("content", 65536), "summary": ("summary", 1200), "title": ("title", 160)}

    def read(r: Column) -> Column:
        told = [cut(r[field], most).alias(name) for name, (field, most) in texts.items()]
        return F.struct(*told, F.lower(cut(r["avatarId"], 64)).alias("avatar_id"), iso(r["capturedAt"]).alias("captured_at"), r["conversationKind"].alias("kind"), r["speakerRole"].alias("role"))

    rest = each.select("source_file", "account", "pos", once(F.from_json("raw", _RECORD), read))
    rest = rest.withColumns({name: F.when(F.col(name) != "", F.col(name)) for name in texts}).where("id IS NOT NULL AND content IS NOT NULL AND captured_at IS NOT NULL AND conversation_id IS NOT NULL")
    rest = rest.withColumn("summary", F.coalesce("summary", F.substring(F.concat_ws(": ", "speaker", "content"), 1, 1200)))
    short = F.when(F.length("summary") > 22, F.concat(F.left("summary", F.lit(22)), F.lit("..."))).otherwise(F.col("summary"))
    made = rest.select(
        "source_file",
        "pos",
        "id",
        F.lit(source).alias("source"),
        F.concat(F.lit("account://"), "account").alias("origin"),
        "conversation_id",
        F.coalesce("conversation_name", "conversation_id").alias("conversation_name"),
        F.when(F.col("kind").isin("direct", "group"), F.col("kind")).otherwise("unknown").alias("conversation_kind"),
        "speaker",
        F.when(F.col("role").isin("self", "other"), F.col("role")).otherwise("unknown").alias("speaker_role"),
        "message_type",
        "content",
        "summary",
        F.coalesce("title", short).alias("title"),
        F.when(F.col("avatar_id").rlike("^[a-f0-9]{64}$"), F.col("avatar_id")).alias("avatar_id"),
        "captured_at",
        F.lit("new").alias("status"),
    )
    gone = listed_in(rows.where("ok"), "deleteIds", account=account).select("source_file", "account", clean(F.col("raw"), 420).alias("id"))
    gone = gone.where(F.startswith("id", F.concat(F.lit(f"{envelope.prefix}:"), "account", F.lit(":")))).select("source_file", "id")
    return made, gone, rows.where("NOT ok").select("source_file")


def chat_operations(documents: DataFrame, envelope: Envelope, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upserts (messages), deletes (id) and rejected documents (source_file). In a document a later row of an id wins, and a
    delete that the document also upserts is dropped; so is one of another account."""
    made, gone, bad = _chat_entries(documents, envelope, source)
    gone = gone.distinct()
    last = F.row_number().over(Window.partitionBy("source_file", "id").orderBy(F.desc("pos")))
    upserts = made.withColumn("nth", last).where("nth = 1").drop("nth", "pos")
    return upserts, gone.join(upserts.select("source_file", "id"), ["source_file", "id"], "left_anti"), bad


def chat_net(documents: DataFrame, envelope: Envelope, source: str) -> tuple[DataFrame, DataFrame]:
    """id, up, row: the one operation of each id that `latest_of` leaves of `chat_operations`, an upsert of a row (up is 1) or a delete, and
    rejected documents. Both rules are one order, of file, upsert before delete, and place, so entries are parsed and shuffled once."""
    made, gone, bad = _chat_entries(documents, envelope, source)
    row = F.struct(*[c for c in made.columns if c not in ("id", "source_file", "pos")])
    ups = made.select("id", F.struct("source_file", F.lit(1).alias("up"), "pos").alias("at"), row.alias("row"))
    downs = gone.select("id", F.struct("source_file", F.lit(0).alias("up"), F.lit(-1).alias("pos")).alias("at"), F.lit(None).cast(ups.schema["row"].dataType).alias("row"))
    last = ups.unionAll(downs).groupBy("id").agg(F.max_by(F.struct("at.up", "row"), "at").alias("x"))
    return last.select("id", "x.up", "x.row"), bad


def latest_of(upserts: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One operation an id over several documents, the last by file name; within one version an upsert beats a delete."""
    ops = upserts.select("id", "source_file", F.lit(1).alias("up")).unionAll(deletes.select("id", "source_file", F.lit(0).alias("up")))
    last = ops.groupBy("id").agg(F.max(F.struct("source_file", "up")).alias("x")).select("id", "x.source_file", "x.up")
    return upserts.join(last.where("up = 1").drop("up"), ["id", "source_file"], "left_semi").drop("source_file"), last.where("up = 0").select("id")


def device_events(documents: DataFrame, envelope: Envelope, producer: str, imported_at: str) -> tuple[DataFrame, DataFrame]:
    """Events of device snapshots and rejected documents. Exact coordinates stay only for a location event whose privacy is
    precise and whose consent is explicit; the last of an id in a document counts."""
    rows = opened(documents, SNAPSHOT, envelope)
    rows = rows.withColumn("ok", F.col("ok") & F.col("doc.events").isNotNull() & F.coalesce(F.col("doc.device.platform").isin(*PLATFORMS), F.lit(False)))
    each = listed_in(rows.where("ok"), "events", platform=lambda doc: doc["device"]["platform"]).withColumn("e", F.from_json("raw", _EVENT)).where(F.col("e.source") == producer)
    start, end = iso(F.col("e.startAt")), iso(F.col("e.endAt"))
    made = each.select("*", F.when(F.col("e.kind").isin(*KINDS), F.col("e.kind")).otherwise("custom").alias("kind"), start.alias("start_at"), F.when(end >= start, end).alias("end_at")).where("start_at IS NOT NULL")
    title = F.coalesce(clean(F.col("e.title"), 240), F.when(F.col("kind") == "location", "Location capture").otherwise("Context event"))
    consent = (F.col("e.locationConsent.exactLocation") == True) & F.col("e.locationConsent.captureMode").isin(*MODES) & iso(F.col("e.locationConsent.grantedAt")).isNotNull()  # noqa: E712
    where = F.col("e.location")
    valid = where["latitude"].between(-90, 90) & where["longitude"].between(-180, 180)
    exact = F.coalesce((F.col("kind") == "location") & (F.col("e.privacy") == "precise") & consent & valid, F.lit(False))
    accuracy = F.when(where["accuracyMeters"] >= 0, F.least(F.lit(1e6), where["accuracyMeters"]))
    entries = F.filter(F.map_entries(F.map_filter("e.values", lambda k, v: k.rlike(VALUE_KEY) & (trimmed(v) != ""))), lambda x: x["key"].isNotNull())
    values = F.map_from_entries(F.slice(F.transform(entries, lambda x: F.struct(x["key"].alias("key"), F.substring(trimmed(x["value"]), 1, 800).alias("value"))), 1, MOST_VALUES))
    fallback = F.concat(F.lit("context-"), F.left(F.sha2(F.concat_ws("\0", F.lit(producer), "kind", "start_at", F.coalesce("end_at", F.lit("")), title, "source_file"), 256), F.lit(20)))
    out = made.select(
        F.coalesce(clean(F.col("e.id"), 160), fallback).alias("id"),
        "kind",
        F.lit(producer).alias("source"),
        "start_at",
        "end_at",
        title.alias("title"),
        clean(F.col("e.summary"), 2400).alias("summary"),
        values.alias("values"),
        "source_file",
        "platform",
        F.coalesce(iso(F.col("e.capturedAt")), F.col("start_at")).alias("captured_at"),
        F.lit(imported_at).alias("imported_at"),
        F.when(exact, "precise").otherwise("coarse").alias("privacy"),
        F.when(exact, F.struct(where["latitude"].alias("latitude"), where["longitude"].alias("longitude"), accuracy.alias("accuracy_m"))).alias("location"),
        "pos",
    )
    last = F.row_number().over(Window.partitionBy("source_file", "id").orderBy(F.desc("pos")))
    return out.withColumn("nth", last).where("nth = 1").drop("nth", "pos"), rows.where("NOT ok").select("source_file")
