"""Cards of people: merged, borne out by messages, listed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import WHITE, compact_key, in_locale
from chatloom.operators.blocks import connected, extended
from chatloom.sources.staging import staged

KEYS = 30


def shown(cards: DataFrame, dismissed: DataFrame | None = None, restored: DataFrame | None = None) -> DataFrame:
    """The cards without those of dismissed conversations (key); a restored conversation (key) is dismissed no longer."""
    if dismissed is None:
        return cards
    keys = dismissed.select("key").distinct()
    if restored is not None:
        keys = keys.join(restored.select("key"), "key", "left_anti")
    gone = cards.select("id", F.explode("keys").alias("key")).join(keys, "key", "left_semi").select("id").distinct()
    return cards.join(gone, "id", "left_anti")


def _whole(cards: DataFrame) -> DataFrame:
    """Cards with who they name; no array is null. A card without a name is nobody else's."""
    none = F.array().cast("array<string>")
    own = F.concat(F.lit("\0"), "id")
    who = compact_key(F.col("name"))
    return cards.withColumns({"source_ids": F.coalesce("source_ids", none), "keys": F.coalesce("keys", none), "who": F.when(who != "", who).otherwise(own)})


def edges(cards: DataFrame) -> DataFrame:
    """a (a card), b: what it has in common with others of its name, a source or a conversation, and itself."""
    rows = _whole(cards)
    marks = F.concat(F.transform("source_ids", lambda x: F.concat(F.lit("s:"), x)), F.transform("keys", lambda x: F.concat(F.lit("k:"), x)), F.array(F.concat(F.lit("c:"), "id")))
    return rows.select(F.concat(F.lit("card "), "id").alias("a"), F.explode(F.transform(F.array_compact(marks), lambda m: F.concat(F.lit("mark "), "who", F.lit(" "), m))).alias("b"))


def people_of(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a person of cards whose labels (node, block) are known."""
    of = labels.where("node LIKE 'card %'").select(F.expr("substring(node, 6)").alias("id"), "block")
    rows = _whole(cards).join(of, "id")
    flat = rows.groupBy("block").agg(
        F.min_by("id", "ord").alias("person"),
        F.min_by("name", "ord").alias("name"),
        F.count("*").alias("cards"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("avatar", F.when(F.col("avatar").isNotNull(), F.col("ord"))).alias("avatar"),
    )
    # a person may have any number of sources: rows, not an array
    sources = rows.select("block", F.explode("source_ids").alias("x")).groupBy("block").agg(F.count_distinct("x").alias("sources"))
    each = rows.select("block", "ord", F.posexplode("keys").alias("pos", "key")).groupBy("block", "key").agg(F.min(F.struct("ord", "pos")).alias("at"))
    first = each.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("at", "key"))).where(F.col("nth") <= KEYS)
    keys = first.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "key"))), lambda x: x["key"]).alias("keys"))
    out = flat.join(sources, "block", "left").join(keys, "block", "left")
    return out.select("person", "name", "cards", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "first_ts", "last_ts", "avatar", "block")


def merged(cards: DataFrame, dismissed: DataFrame | None = None, restored: DataFrame | None = None) -> DataFrame:
    """One row a person of cards (id, ord, name, source_ids, keys, first_ts, last_ts, avatar): cards of one name that share a source
    or a conversation, directly or by others, are one person. Cards of dismissed conversations (key) take no part unless they
    are restored (key). Null arrays are empty, and a card without a name is a person of its own, so no card is lost.

    Cards are not folded one by one: what is one person does not hang on the order in which cards come. Links go from a card
    to its name's sources and conversations, so no two cards are compared, however many have a name."""
    rows = shown(cards, dismissed, restored)
    return people_of(rows, connected(edges(rows))).drop("block")


class State(NamedTuple):
    """What is kept of people between imports: cards, labels (node, block) and people (as merged gives them, with their block)."""

    cards: DataFrame
    labels: DataFrame
    people: DataFrame


def begun(cards: DataFrame) -> State:
    """The state of the first cards."""
    labels = connected(edges(cards))
    return State(cards, labels, people_of(cards, labels))


def joined(state: State, additions: DataFrame) -> tuple[State, DataFrame]:
    """The state with the additions (cards, of which a known id is left out), and touched: block, was (the blocks that it takes in),
    of the people that they make or change. Only these are put together anew: old components count as one node each, so the work
    is that of the additions and of whom they touch; the result is that of merging all cards at once."""
    new = staged(additions.join(state.cards.select("id"), "id", "left_anti"), "cards")
    labels, moved = extended(state.labels, edges(new))
    touched = staged(moved, "touched")
    blocks = touched.select(F.col("block").alias("touched_block")).distinct()
    cards = staged(state.cards.unionByName(new), "cards")
    within = labels.join(blocks, F.col("block") == F.col("touched_block"), "left_semi")
    ids = within.where("node LIKE 'card %'").select(F.expr("substring(node, 6)").alias("id"))
    fresh = people_of(cards.join(ids, "id", "left_semi"), within)
    old = state.people.join(touched.select(F.col("was").alias("block")), "block", "left_anti").join(blocks, F.col("block") == F.col("touched_block"), "left_anti")
    return State(cards, labels, staged(old.select(fresh.columns).unionByName(fresh), "people")), touched


def portraits_kept(portraits: DataFrame, people: DataFrame, now: DataFrame) -> DataFrame:
    """portraits (person, signature, retries) with a state: `ready` if the person is there and their evidence has the signature it
    was made of; else `processing`, without signature or retries. A person that another has taken in has none. now: person, signature."""
    rows = portraits.join(people.select("person"), "person", "left_semi").join(now.select("person", F.col("signature").alias("is_now")), "person", "left")
    same = F.col("signature").eqNullSafe(F.col("is_now")) & F.col("signature").isNotNull()
    return rows.select("person", F.when(same, F.col("signature")).alias("signature"), F.when(same, F.coalesce("retries", F.lit(0))).otherwise(0).alias("retries"), F.when(same, "ready").otherwise("processing").alias("state"))


def enriched(people: DataFrame, messages: DataFrame) -> DataFrame:
    """people (person, name, source_ids, keys, first_ts, last_ts, avatar) with what messages (id, key, own_kind, speaker, captured_ts,
    avatar) tell: the avatar of their name, else of a direct conversation of theirs, else their own; times of cited rows where they have none."""
    pictured = messages.where("avatar IS NOT NULL")
    by_name = pictured.where("trim(speaker) <> ''").groupBy(compact_key(F.col("speaker")).alias("who")).agg(F.max_by("avatar", "id").alias("name_avatar"))
    by_key = pictured.where("own_kind = 'direct'").groupBy("key").agg(F.min_by("avatar", "id").alias("key_avatar"))
    keyed = people.select("person", F.posexplode("keys").alias("pos", "key")).join(by_key, "key").groupBy("person").agg(F.min_by("key_avatar", "pos").alias("key_avatar"))
    cited = people.select("person", F.explode("source_ids").alias("id")).join(messages.select("id", "captured_ts"), "id")
    times = cited.groupBy("person").agg(F.min("captured_ts").alias("cited_first"), F.max("captured_ts").alias("cited_last"), F.count("*").alias("cited"))
    out = people.withColumn("who", compact_key(F.col("name"))).join(by_name, "who", "left").join(keyed, "person", "left").join(times, "person", "left")
    known = F.col("cited").isNotNull()
    return out.select(
        "person",
        F.when(known, F.coalesce("name_avatar", "key_avatar", "avatar")).otherwise(F.col("avatar")).alias("avatar"),
        F.coalesce("first_ts", "cited_first").alias("first_ts"),
        F.coalesce("last_ts", "cited_last").alias("last_ts"),
    )


def ordered(people: DataFrame, mode: str = "recent") -> DataFrame:
    """People (name, last_ts, sources, conversations) by name in the order of its language, by how much is known (`coverage`), or
    the latest first."""
    name = in_locale("name").asc()
    known = [F.desc("sources"), F.desc("conversations"), name]
    by = {"name": [name, F.asc("name")], "coverage": known, "recent": [F.col("last_ts").desc_nulls_last(), *known]}
    return people.orderBy(*by[mode])


def searched(people: DataFrame, text: str, most: int) -> DataFrame:
    """The `most` latest people of whom anything that is shown holds a text: name, platforms, facts, preferences (arrays), portrait,
    notes, as far as people has them. A blank text asks for all."""
    asked = text.strip(WHITE).lower()
    of = [F.concat_ws(" ", c) for c in ("name", "platforms", "facts", "preferences", "portrait", "notes") if c in people.columns]
    found = people.where(F.contains(F.lower(F.concat_ws(" ", *of)), F.lit(asked))) if asked else people
    return found.orderBy(F.col("last_ts").desc_nulls_last(), in_locale("name"), "name").limit(most)


def newest_evidence(claims: DataFrame, most: int, by: str = "person_id") -> DataFrame:
    """The `most` latest claims of each person, by their last or first time, then their text in the order of its language."""
    at = F.coalesce("last_ts", "first_ts")
    nth = F.row_number().over(Window.partitionBy(by).orderBy(at.desc_nulls_last(), in_locale("text"), "text", "claim_id"))
    return claims.withColumn("nth", nth).where(F.col("nth") <= most)


def linked_records(people: DataFrame, messages: DataFrame) -> DataFrame:
    """person, id: the messages of a person's conversations (keys) and those that they are known from (source_ids)."""
    by_key = people.select("person", F.explode("keys").alias("key")).distinct().join(messages.select("id", "key"), "key").select("person", "id")
    cited = people.select("person", F.explode("source_ids").alias("id")).join(messages.select("id"), "id").select("person", "id")
    return by_key.unionAll(cited).distinct()


def devices(events: DataFrame) -> DataFrame:
    """platform, events, latest: events of devices by the platform that their file tells."""
    file = F.coalesce("source_file", F.lit(""))
    platform = F.when(file.rlike("(?i)android"), "android").when(file.rlike("(?i)windows"), "windows").otherwise("unknown")
    return events.groupBy(platform.alias("platform")).agg(F.count("*").alias("events"), F.max("start_ts").alias("latest"))


def reconciled_counts(expected: DataFrame, archived: DataFrame, by: str) -> DataFrame:
    """by, expected, archived, state: whether as many rows are archived as were announced (by, expected)."""
    have = archived.groupBy(by).agg(F.count("*").alias("archived"))
    both = expected.join(have, by, "full").select(by, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("archived", F.lit(0)).alias("archived"))
    return both.withColumn("state", F.when(F.col("archived") == F.col("expected"), "complete").when(F.col("archived") < F.col("expected"), "behind").otherwise("ahead"))


def distinct_places(found: DataFrame) -> DataFrame:
    """Looked-up places (query, rank, lat, lon), one for each position to five decimals: the first."""
    lat, lon = F.format_number("lat", 5), F.format_number("lon", 5)
    first = F.row_number().over(Window.partitionBy("query", lat, lon).orderBy("rank"))
    return found.withColumn("nth", first).where("nth = 1").drop("nth")
