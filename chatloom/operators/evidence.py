"""Claims about people and the messages that bear them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.claims import eligible
from chatloom.functions.columns import text_key
from chatloom.operators.segments import placed

RECENT_DAYS, WORKSET, SOURCES = 30, 96, 12
FINGERPRINT_BLOCK = 4096
#: Shares of the workset that are full after each pass.
QUOTAS = (0.42, 0.60, 0.78, 0.88, 1.0)


def merged_claims(claims: DataFrame, *by: str) -> DataFrame:
    """One claim of those with the same key: the first SOURCES sources by time, times, and whether it is repeated.

    The sources are ranked apart from the sums: a rank with a limit is cut in every task before it is shuffled, so a claim with
    any number of sources sends SOURCES of them a task, and the sums are partial."""
    once = claims.groupBy(*by, "source_id").agg(F.min("observed_ts").alias("observed_ts"), F.max("observed_ts").alias("until_ts"), F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("observed_ts", "source_id"))
    first = once.select(*by, "observed_ts", "source_id", nth.alias("nth")).where(F.col("nth") <= SOURCES)
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "source_id"))), lambda x: x["source_id"]), ",")
    listed = first.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(sources.alias("sources"))
    sums = once.groupBy(*by).agg(F.count("*").alias("n_sources"), F.min("observed_ts").alias("first_ts"), F.max("until_ts").alias("last_ts"), F.max("score").alias("score"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    out = sums.join(listed, same).withColumn("strength", F.when(F.col("n_sources") > 1, "repeated").otherwise("single"))
    return out.select(*by, "sources", "n_sources", "first_ts", "last_ts", "score", "strength")


def scope(at: Column, as_of: str, days: int = RECENT_DAYS) -> Column:
    """recent, historical or undated."""
    return F.when(at.isNull(), "undated").when(at >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max(1, days))), "recent").otherwise("historical")


def stability(n_sources: Column, first: Column, last: Column) -> Column:
    """persistent: three sources, or two at least thirty days apart; repeated: two."""
    return F.when((n_sources >= 3) | ((n_sources >= 2) & (F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp")) >= 30 * 86400)), "persistent").when(n_sources >= 2, "repeated").otherwise("single")


def scope_summary(claims: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Claims and distinct sources by scope, the age of the latest, and whether they are enough for a portrait."""
    rows = claims.withColumn("scope", scope(F.col("observed_ts"), as_of))
    out = rows.groupBy(*by).agg(
        *[F.count_if(F.col("scope") == s).alias(f"n_{s}") for s in ("recent", "historical", "undated")],
        *[F.count_distinct(F.when(F.col("scope") == s, F.col("source_id"))).alias(f"sources_{s}") for s in ("recent", "historical")],
        F.date_diff(F.lit(as_of).cast("timestamp_ntz").cast("date"), F.max("observed_ts").cast("date")).cast("long").alias("latest_days"),
    )
    return out.withColumn("status", F.when(F.col("n_recent") == 0, "none").when((F.col("n_recent") < 6) | (F.col("sources_recent") < 4), "limited").otherwise("available"))


def best_each_month(claims: DataFrame, *by: str) -> DataFrame:
    """The claim of the highest score in each month, of equals the first."""
    month = F.date_format("observed_ts", "yyyy-MM")
    best = F.row_number().over(Window.partitionBy(*by, "month").orderBy(F.desc("score"), "observed_ts", "source_id"))
    return claims.withColumn("month", month).withColumn("nth", best).where("nth = 1").drop("nth")


def workset(claims: DataFrame, as_of: str, limit: int = WORKSET, by: str = "person_id") -> DataFrame:
    """At most `limit` claims a person, in time order, filled in passes: events and claims of boundaries and interaction by score
    to the first quota, then the best of each month, recent ones, repeated ones (`strength`), all. The first three take only
    what may go into a portrait. claims: by, kind, category, observed_ts, source_id, score, strength.

    A claim belongs to the first pass that reaches it, and a pass takes what its quota leaves room for: five windows over
    each person's claims, no loop over rows."""
    time = [F.col("observed_ts").asc_nulls_last(), F.col("source_id").asc()]
    person = Window.partitionBy(by)
    rows = claims.withColumn("place", F.row_number().over(person.orderBy(*time))).withColumn("total", F.count("*").over(person))
    month = F.coalesce(F.date_format("observed_ts", "yyyy-MM"), F.concat(F.lit("undated-"), F.col("place").cast("string")))
    rows = rows.withColumn("month", month).withColumn("fit", eligible(F.col("category")))
    rows = rows.withColumn("best", F.col("fit") & (F.row_number().over(Window.partitionBy(by, "month").orderBy(F.desc("fit"), F.desc("score"), "place")) == 1))
    passes = [
        (F.col("fit") & ((F.col("kind") == "event") | F.col("category").isin("boundary", "interaction")), [F.desc("score"), F.desc("place")]),
        (F.col("best"), [F.asc("place")]),
        (F.col("fit") & (scope(F.col("observed_ts"), as_of) == "recent"), [F.desc("score"), F.desc("place")]),
        (F.col("strength") == "repeated", [F.desc("score"), F.desc("place")]),
        (F.lit(True), [F.desc("score"), F.asc("place")]),
    ]
    rows = rows.withColumn("taken", F.col("total") <= limit)
    for (wanted, order), quota in zip(passes, QUOTAS, strict=True):
        open_ = ~F.col("taken") & wanted
        so_far = F.count_if("taken").over(person)
        turn = F.sum(open_.cast("int")).over(Window.partitionBy(by).orderBy(F.when(open_, 0).otherwise(1), *order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("so_far", so_far).withColumn("turn", turn)
        rows = rows.withColumn("taken", F.col("taken") | (open_ & (F.col("so_far") + F.col("turn") <= int(limit * quota + 1e-9)))).drop("so_far", "turn")
    return rows.where("taken").drop("taken", "total", "best", "month", "fit")


def verified(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """Claims whose quote is found in a message of somebody else that they cite. claims: claim_id, quote, source_ids."""
    cited = claims.select("claim_id", text_key(F.col("quote")).alias("needle"), F.explode("source_ids").alias("id"))
    said = messages.where("speaker_role = 'other'").select("id", "captured_ts", text_key(F.col("content")).alias("hay"))
    found = cited.join(said, "id").where((F.length("needle") > 0) & F.contains("hay", F.col("needle")))
    ok = found.groupBy("claim_id").agg(F.array_sort(F.collect_set("id")).alias("verified_ids"), F.min("captured_ts").alias("first_ts"), F.max("captured_ts").alias("last_ts"))
    return claims.join(ok, "claim_id").drop("source_ids").withColumnRenamed("verified_ids", "source_ids")


def fingerprints(messages: DataFrame, key: str) -> DataFrame:
    """key, rows, digest: changes with a conversation's members, times, speakers or texts. Rows are numbered by sorted ranges and
    their hashes hashed in blocks of `FINGERPRINT_BLOCK`, whose hashes make the digest: a long conversation is many tasks, and
    what comes together in one is a hash a block."""
    row = F.sha2(F.concat_ws("\u001f", "id", F.coalesce(F.date_format("captured_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), F.coalesce("speaker", F.lit("")), F.coalesce("speaker_role", F.lit("")), F.coalesce("content", F.lit(""))), 256)
    return digests(messages.select(key, "captured_ts", "id", row.alias("row")), key, [F.col("captured_ts").asc_nulls_last(), F.col("id")])


def digests(hashed: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key, rows, digest of the hashes (row) of each key's rows in their order."""
    rows = placed(hashed, key, order)

    def joined(at: str, value: str):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]), "\u001e"), 256)

    blocks = rows.withColumn("block", F.floor(F.col("place") / FINGERPRINT_BLOCK)).groupBy(key, "block").agg(F.count("*").alias("n"), joined("place", "row").alias("part"))
    return blocks.groupBy(key).agg(F.sum("n").alias("rows"), joined("block", "part").alias("digest"))


def completed(messages: DataFrame, analyzed: DataFrame, key: str) -> DataFrame:
    """Conversations of which every message is analyzed (analyzed: id)."""
    marked = messages.join(analyzed.select("id").distinct().withColumn("done", F.lit(True)), "id", "left")
    return marked.groupBy(key).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("complete"), F.count("*").alias("rows")).where("complete").select(key, "rows")


def pending(messages: DataFrame, watermarks: DataFrame, key: str) -> DataFrame:
    """One row: conversations and messages whose fingerprint is not that of the watermark (key, digest)."""
    now = fingerprints(messages, key)
    due = now.join(watermarks.select(key, F.col("digest").alias("seen")), key, "left").where("seen IS NULL OR seen <> digest")
    return due.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("rows"), F.lit(0)).alias("messages"))


def scoped(messages: DataFrame, prints: DataFrame, watermarks: DataFrame, scope: str, targets: frozenset[str]) -> DataFrame:
    """The messages (key, status, own_kind, ai_analyzed_at) that an analysis takes: `all`, `new` ones, or of those the `pending` ones,
    by what is asked for (tasks, people). prints: key, digest; watermarks: key, target, digest.

    A conversation is pending for people if it is direct and its watermark is not its fingerprint, for tasks if its watermark is
    not; for tasks alone a message that has been analyzed is not taken again. Without a fingerprint all are pending."""
    if scope == "all":
        return messages
    new = messages.where("status = 'new'")
    if scope == "new":
        return new
    marks = watermarks.groupBy("key").agg(*[F.max(F.when(F.col("target") == t, F.col("digest"))).alias(f"seen_{t}") for t in ("tasks", "people")])
    rows = new.join(prints.select("key", F.col("digest").alias("print")), "key", "left").join(marks, "key", "left")
    tasks = ~F.col("seen_tasks").eqNullSafe(F.col("print"))
    people = (F.col("own_kind") == "direct") & ~F.col("seen_people").eqNullSafe(F.col("print"))
    asked = tasks | people if targets >= {"tasks", "people"} else people if "people" in targets else tasks & F.col("ai_analyzed_at").isNull()
    return rows.where(F.col("print").isNull() | asked).drop("print", "seen_tasks", "seen_people")
