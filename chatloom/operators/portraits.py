"""Portraits of people: claims borne out and cited, blocks of text judged by rules, and who is due for a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.claims import anchored, category, eligible, overstates, past_tense, score, unsupported_numbers, uses_notes
from chatloom.functions.columns import fnv1a36, text_key, trimmed
from chatloom.operators.evidence import digests, scope, stability

TEXT, QUOTE, SOURCES, KEYS, PLATFORMS = 360, 100, 12, 30, 8
BLOCKS, BLOCK_TEXT, BLOCK_CLAIMS, NOTES, ATTEMPTS, RETRIES = 8, 1800, 12, 80, 2, 3

# The name that stands for a user's notes, the wordings that disclaim, the reasons that a block may give.
MANUAL = "user-profile-notes"
DISCLAIMER = "证据不足|信息不足|无法据此判断|需要更多信息"
DISCLAIMER_WIDE = "证据(?:不足|有限)|信息(?:不足|有限)|无法(?:据此判断|确认|确定)|尚不明确|暂无法判断|需要更多信息"
REASONS = ("background", "preference", "habit", "interaction", "change", "trajectory", "other")


def borne_out(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """Claims that a message of their person bears out, with category, stability, score and eligible. claims: claim_id, name, key,
    expected, kind, text, quote, source_ids; messages: id, key, speaker, speaker_role, content, captured_ts.

    A message counts if it is among the first SOURCES cited ones of the claim's conversation, its speaker has the claim's name (or
    no other speaker is named there and the conversation is expected to be with that name) and it holds the quote. One message
    does not bear out a word stronger than its own."""
    rows = claims.withColumns({"text": F.substring(trimmed("text"), 1, TEXT), "quote": F.substring(trimmed("quote"), 1, QUOTE)})
    rows = rows.withColumns({"needle": text_key(F.col("quote")), "who": text_key(F.col("name")), "due": text_key(F.coalesce("expected", F.lit("")))})
    rows = rows.where((F.col("text") != "") & (F.length("needle") >= 2) & (F.col("who") != ""))
    cited = rows.select("claim_id", "key", "needle", "who", "due", F.posexplode(F.array_distinct("source_ids")).alias("pos", "id"))
    said = messages.select("key", "id", "captured_ts", "speaker_role", text_key(F.coalesce("speaker", F.lit(""))).alias("said"), text_key(F.col("content")).alias("hay"))
    named = messages.where("speaker_role = 'other'").groupBy("key").agg(F.count_if(trimmed(F.coalesce("speaker", F.lit(""))) != "").alias("named"))
    found = cited.join(said, ["key", "id"]).join(named, "key")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("claim_id").orderBy("pos"))).where(F.col("nth") <= SOURCES)
    theirs = (F.col("said") == F.col("who")) | ((F.col("who") == F.col("due")) & (F.col("named") == 0))
    ok = found.where((F.col("speaker_role") == "other") & theirs & F.contains("hay", F.col("needle"))).groupBy("claim_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("source_ids"), F.min("captured_ts").alias("first_ts"), F.max("captured_ts").alias("last_ts")
    )
    out = rows.drop("source_ids", "needle", "who", "due").join(ok, "claim_id")
    out = out.where((F.size("source_ids") > 1) | ~overstates(F.col("text"), F.col("quote")))
    out = out.withColumns({"category": category(F.col("kind"), F.col("text"), F.col("quote")), "stability": stability(F.size("source_ids"), F.col("first_ts"), F.col("last_ts"))})
    told = score(F.col("kind"), F.col("text"), F.col("quote"), F.col("stability"), F.col("category"))
    return out.withColumns({"score": told, "eligible": eligible(F.col("category"))})


def cards(claims: DataFrame, messages: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """Cards (card, person, name, facts, preferences, events, sources, first_ts, last_ts, keys, platforms) of claims that are borne
    out: card, nth, name, kind, text, source_ids. With core (id), claims that cite none of it do not count; a card without claims goes."""
    each = claims.select("card", "nth", "name", "claim_id", "kind", F.explode("source_ids").alias("id"))
    if core is not None:
        cited = each.join(core.select("id").distinct(), "id", "left_semi").select("claim_id").distinct()
        each = each.join(cited, "claim_id", "left_semi")
    each = each.join(messages.select("id", "key", "source", "captured_ts"), "id")

    def kinds(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("claim_id")))

    out = each.groupBy("card", "nth", "name").agg(
        kinds("fact").alias("facts"),
        kinds("preference").alias("preferences"),
        kinds("event").alias("events"),
        F.array_sort(F.collect_set("id")).alias("source_ids"),  # a card is one answer about one segment
        F.min("captured_ts").alias("first_ts"),
        F.max("captured_ts").alias("last_ts"),
        F.slice(F.array_sort(F.collect_set("key")), 1, KEYS).alias("keys"),
        F.slice(F.array_sort(F.collect_set("source")), 1, PLATFORMS).alias("platforms"),
    )
    person = F.concat(F.lit("person-"), fnv1a36(F.concat(F.substring(trimmed("name"), 1, 120), F.lit("|"), F.array_join("source_ids", ","))), F.lit("-"), F.col("nth").cast("string"))
    return out.withColumn("person", person).withColumn("sources", F.size("source_ids").cast("long"))


def resolved_claims(returned: DataFrame, registry: DataFrame, most: int) -> DataFrame:
    """person, kind, claim_id, nth: the first `most` different claims that an answer's entries stand for. An entry (person, kind,
    pos, claim_id, text, quote) is the claim of that id and kind, else the first (ord) of that kind with its text or quote."""
    known = registry.select("person", "kind", "claim_id").distinct().withColumn("known", F.lit(True))

    def first(column: str) -> DataFrame:
        rows = registry.select("person", "kind", text_key(F.col(column)).alias(f"{column}_key"), F.struct("ord", "claim_id").alias("at"))
        return rows.where(F.col(f"{column}_key") != "").groupBy("person", "kind", f"{column}_key").agg(F.min("at").alias(f"by_{column}"))

    asked = returned.withColumns({"text_key": text_key(F.col("text")), "quote_key": text_key(F.col("quote"))}).join(known, ["person", "kind", "claim_id"], "left")
    asked = asked.join(first("text"), ["person", "kind", "text_key"], "left").join(first("quote"), ["person", "kind", "quote_key"], "left")
    claim = F.when(F.col("known"), F.col("claim_id")).otherwise(F.least("by_text", "by_quote")["claim_id"])
    found = asked.select("person", "kind", "pos", claim.alias("claim_id")).where("claim_id IS NOT NULL").groupBy("person", "kind", "claim_id").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("person", "kind").orderBy("pos", "claim_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("pos")


def checked_blocks(blocks: DataFrame, registry: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """person, pos, text, claim_ids, source_ids, reason, scope, from_ts, to_ts, manual, issue: the first BLOCKS blocks of each
    portrait with the first rule that each breaks (null: none). blocks: person, pos (from 1), text, claim_ids, reason; registry:
    person, claim_id, text, quote, source_ids, eligible, first_ts, last_ts; notes: person, notes."""
    rows = blocks.where(F.col("pos") <= BLOCKS).select("person", "pos", F.substring(trimmed(F.coalesce("text", F.lit(""))), 1, BLOCK_TEXT).alias("text"), F.slice(F.array_distinct(F.coalesce("claim_ids", F.array().cast("array<string>"))), 1, BLOCK_CLAIMS).alias("claim_ids"), F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise("other").alias("reason"))
    at = F.coalesce("last_ts", "first_ts")
    known = registry.select("person", "claim_id", F.struct("claim_id", F.col("text").alias("text"), "quote", "source_ids", "eligible", scope(at, as_of).alias("scope"), F.coalesce("first_ts", "last_ts").alias("from_ts"), at.alias("to_ts")).alias("claim"))
    cited = rows.select("person", "pos", F.posexplode("claim_ids").alias("at", "claim_id")).join(known, ["person", "claim_id"])
    # at most BLOCK_CLAIMS claims a block
    held = cited.groupBy("person", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "claim"))), lambda x: x["claim"]).alias("claims"))
    rows = rows.join(held, ["person", "pos"], "left").join(notes.select("person", trimmed(F.coalesce("notes", F.lit(""))).alias("notes")), "person", "left")
    rows = rows.withColumns({"notes": F.coalesce("notes", F.lit("")), "claims": F.coalesce("claims", F.array().cast(held.schema["claims"].dataType))})
    rows = rows.withColumn("manual", F.array_contains("claim_ids", MANUAL) & (F.col("notes") != ""))
    claims, text = F.col("claims"), F.col("text")
    sentences = F.filter(F.split(text, r"[。！？!?；;\n]+"), lambda s: trimmed(s) != "")
    anchor = (F.size(sentences) > 0) & F.forall(sentences, lambda s: F.exists(claims, lambda c: anchored(s, c["text"], c["quote"])))
    allowed = F.concat_ws(" ", F.transform(claims, lambda c: F.concat_ws(" ", c["text"], c["quote"])), F.col("notes"))
    recent, past = F.exists(claims, lambda c: c["scope"] == "recent"), F.exists(claims, lambda c: c["scope"] == "historical")
    told = F.when(recent & past, "change").when(recent, "recent").when(past, "historical").otherwise("undated")
    has = F.size(claims) > 0
    issue = (
        F.when((text == "") | (~has & ~F.col("manual")), "missing-text-or-claims")
        .when(text.rlike(DISCLAIMER), "disclaimer")
        .when(F.exists(claims, lambda c: ~c["eligible"]), "claim-not-for-portraits")
        .when(F.col("manual") & ~uses_notes(text, F.col("notes")), "no-anchor-in-notes")
        .when(text.rlike(DISCLAIMER_WIDE), "disclaimer")
        .when(has & ~anchor, "no-anchor-in-claims")
        .when(F.size(unsupported_numbers(text, allowed)) > 0, "unsupported-number")
        .when((F.col("scope") == "historical") & ~past_tense(text), "past-needs-past-tense")
        .when((F.col("scope") == "change") & ~F.col("reason").isin("change", "trajectory"), "change-needs-its-reason")
    )
    rows = rows.withColumn("scope", told).withColumn("issue", issue)
    sources = F.slice(F.array_distinct(F.flatten(F.transform(claims, lambda c: c["source_ids"]))), 1, SOURCES)
    cited = F.transform(claims, lambda c: c["claim_id"])
    return rows.select("person", "pos", "text", cited.alias("claim_ids"), sources.alias("source_ids"), "reason", "scope", F.array_min(F.transform(claims, lambda c: c["from_ts"])).alias("from_ts"), F.array_max(F.transform(claims, lambda c: c["to_ts"])).alias("to_ts"), "manual", "issue")


def checked_portraits(checked: DataFrame, registry: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """person, blocks, issues: how many blocks a portrait keeps, and what it breaks, comma-joined: its blocks' issues and its own.
    A portrait needs two sources from chats or the user's notes; a block that is up to date, where two recent claims of two
    sources are; and any block at all, where three lasting claims are or long notes."""
    good = F.col("issue").isNull()
    of_blocks = checked.groupBy("person").agg(F.count_if(good).alias("good"), F.bool_or(good & F.col("manual")).alias("manual"), F.bool_or(good & F.col("scope").isin("recent", "change")).alias("current"), F.collect_set("issue").alias("issues"))
    cited = checked.where(good).select("person", F.explode("source_ids").alias("id")).groupBy("person").agg(F.count_distinct("id").alias("cited"))
    claims = registry.where("eligible").withColumn("scope", scope(F.coalesce("last_ts", "first_ts"), as_of))
    lasting = claims.groupBy("person").agg(F.count("*").alias("lasting"), F.count_if(F.col("scope") == "recent").alias("recent"))
    sources = claims.where("scope = 'recent'").select("person", F.explode("source_ids").alias("id")).groupBy("person").agg(F.count_distinct("id").alias("recent_sources"))
    people = registry.select("person").union(notes.select("person")).union(checked.select("person")).distinct()
    rows = people
    for part in (of_blocks, cited, lasting, sources, notes.select("person", F.length(trimmed("notes")).alias("noted"))):
        rows = rows.join(part, "person", "left")
    rows = rows.na.fill(0, ["good", "cited", "lasting", "recent", "recent_sources", "noted"]).na.fill(False, ["manual", "current"])
    own = F.array(
        F.when((F.col("good") > 0) & ~F.col("manual") & (F.col("cited") < 2), "needs-two-sources"),
        F.when((F.col("recent") >= 2) & (F.col("recent_sources") >= 2) & ~F.col("current"), "needs-a-recent-block"),
        F.when((F.col("good") == 0) & ((F.col("lasting") >= 3) | (F.col("noted") >= NOTES)), "portrait-expected"),
    )
    issues = F.array_sort(F.array_compact(F.concat(F.coalesce("issues", F.array().cast("array<string>")), own)))
    kept = F.when((F.col("cited") >= 2) | F.col("manual"), F.col("good")).otherwise(0).cast("long")
    return rows.select("person", kept.alias("blocks"), F.array_join(issues, ",").alias("issues"))


def consolidated(attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """person, attempt, portrait, facts, preferences: the first of a person's ATTEMPTS attempts without issues, if it says anything,
    with the number of all claims in the registry, not of those that it cites. attempts: person, attempt, issues, portrait, stated."""
    clean = attempts.where((F.col("attempt") <= ATTEMPTS) & (F.coalesce("issues", F.lit("")) == ""))
    first = clean.groupBy("person").agg(F.min("attempt").alias("attempt"), F.min_by("portrait", "attempt").alias("portrait"), F.min_by("stated", "attempt").alias("stated"))
    first = first.where((F.col("stated") > 0) | (F.coalesce("portrait", F.lit("")) != "")).drop("stated")
    counts = registry.groupBy("person").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("fact", "facts"), ("preference", "preferences"))])
    return first.join(counts, "person", "left").na.fill(0, ["facts", "preferences"])


def signatures(registry: DataFrame, notes: DataFrame, version: str) -> DataFrame:
    """person, signature: changes with the version, the person's notes and any of their claims (person, ord, claim_id, kind, text,
    quote, source_ids, score, first_ts, last_ts); nobody without both. A person's claims are hashed in blocks of sorted ranges."""
    row = F.sha2(F.to_json(F.struct("kind", "text", "quote", F.array_sort("source_ids").alias("source_ids"), "score", "first_ts", "last_ts")), 256)
    claims = digests(registry.select("person", "ord", "claim_id", row.alias("row")), "person", [F.col("ord"), F.col("claim_id")])
    noted = notes.select("person", trimmed("notes").alias("notes")).where("notes <> ''")
    rows = claims.join(noted, "person", "full")
    return rows.select("person", F.sha2(F.concat_ws("\u001f", F.lit(version), F.coalesce("digest", F.lit("")), F.coalesce("notes", F.lit(""))), 256).alias("signature"))


def queue(people: DataFrame, now: DataFrame, running: DataFrame, slots: int) -> DataFrame:
    """person, attempt: the first `slots` people (person, ord, signature, retries) whose signature is not that of now (person,
    signature), who are not running (person) and have not failed RETRIES times."""
    due = people.join(now.withColumnRenamed("signature", "is_now"), "person").where(~F.col("signature").eqNullSafe(F.col("is_now")))
    due = due.where(F.coalesce("retries", F.lit(0)) < RETRIES).join(running.select("person"), "person", "left_anti")
    return due.orderBy("ord", "person").limit(slots).select("person", (F.coalesce("retries", F.lit(0)) + 1).alias("attempt"))
