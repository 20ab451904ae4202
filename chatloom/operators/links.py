"""Joins of messages with events, tasks, people and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import conversation_key, text_key
from chatloom.operators.segments import BLOCK, in_blocks, placed

#: Rows of a table that may be broadcast for a join that no key can do.
SMALL = 10_000


def whole_conversations(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """All messages of the conversations that have a selected one (selected: id)."""
    keyed = messages.withColumn("key", conversation_key())
    return keyed.join(keyed.join(selected.select("id"), "id", "left_semi").select("key").distinct(), "key", "left_semi")


def with_context(rows: DataFrame, new: str, before: int, key: str, order: list, block: int = BLOCK) -> DataFrame:
    """The rows that are new, and those up to `before` rows ahead of a new one in their conversation. A frame, no self-join; rows are
    numbered by sorted ranges and framed in blocks that see the first rows of the next, so a conversation is many tasks."""
    dealt = in_blocks(placed(rows, key, order), after=before, block=block)
    ahead = Window.partitionBy(key, "block").orderBy("place").rowsBetween(0, before)
    near = dealt.withColumn("near", F.max(F.col(new)).over(ahead))
    return near.where("own AND near").drop("near", "own", "block", "place")


def carried_forward(rows: DataFrame, column: str, key: str, order: list, block: int = BLOCK) -> DataFrame:
    """The column's last value that is known, as of each row. Each block of a key tells its last value, one short row; what the
    blocks before it tell goes to the rows of a block ahead of its first own value."""
    dealt = in_blocks(placed(rows, key, order), block=block)
    told = dealt.where(F.col(column).isNotNull()).groupBy(F.col(key).alias("told_key"), F.col("block").alias("told_block")).agg(F.max_by(column, "place").alias("told"))
    every = dealt.groupBy(F.col(key).alias("of_key"), F.col("block").alias("of_block")).agg(F.lit(1).alias("one"))
    every = every.join(told, F.col("of_key").eqNullSafe(F.col("told_key")) & (F.col("of_block") == F.col("told_block")), "left")
    earlier = Window.partitionBy("of_key").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("of_key", "of_block", F.last("told", ignorenulls=True).over(earlier).alias("carried")).where("carried IS NOT NULL")
    so_far = Window.partitionBy(key, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumn(column, F.last(column, ignorenulls=True).over(so_far))
    out = within.join(carried, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("block") == F.col("of_block")), "left")
    return out.withColumn(column, F.coalesce(column, "carried")).drop("own", "block", "place", "of_key", "of_block", "carried")


def overlapping(events: DataFrame, spans: DataFrame, by: list[str], bin_seconds: int) -> DataFrame:
    """Events and spans of the same `by` that meet: start_ts <= last_ts and coalesce(end_ts, start_ts) >= first_ts.

    Both sides are dealt into bins of time that they touch, so the join has keys and a busy user is many groups; a pair is
    kept in the first bin that both touch. spans: by, span, first_ts, last_ts."""

    def seconds(c):
        return F.unix_timestamp(F.col(c).cast("timestamp"))

    def bins(a, b):
        return F.explode(F.sequence(F.floor(a / bin_seconds), F.floor(F.greatest(a, b) / bin_seconds)))

    ev = events.withColumn("until_ts", F.coalesce("end_ts", "start_ts"))
    ev = ev.where("until_ts >= start_ts").withColumn("bin", bins(seconds("start_ts"), seconds("until_ts")))
    sp = spans.withColumn("bin", bins(seconds("first_ts"), seconds("last_ts")))
    met = ev.join(sp, [*by, "bin"]).where((F.col("start_ts") <= F.col("last_ts")) & (F.col("until_ts") >= F.col("first_ts")))
    first = F.floor(F.greatest(seconds("start_ts"), seconds("first_ts")) / bin_seconds)
    return met.where(F.col("bin") == first).drop("bin", "until_ts")


def person_links(tasks: DataFrame, task_sources: DataFrame, messages: DataFrame, people: DataFrame) -> DataFrame:
    """task, person: people named like another speaker that a task cites, or of whose direct conversation it cites a message.

    task_sources: task, id; people: person, name, key (of their conversation or null)."""
    cited = task_sources.join(messages.withColumn("key", conversation_key()).select("id", "key", "speaker", "speaker_role"), "id")
    named = people.select("person", text_key(F.col("name")).alias("canonical")).where("canonical <> ''")
    by_name = cited.where("speaker_role = 'other'").withColumn("canonical", text_key(F.col("speaker"))).join(named, "canonical").select("task", "person")
    by_place = cited.join(people.where("key IS NOT NULL").select("person", "key"), "key").select("task", "person")
    return by_name.unionAll(by_place).distinct().join(tasks.select(F.col("id").alias("task")), "task", "left_semi")


def without_dangling(rows: DataFrame, array: str, known: DataFrame, known_id: str) -> DataFrame:
    """The array column keeps, in their order, the ids that the other table has."""
    kept = rows.select("id", F.posexplode(array).alias("pos", "one")).join(known.select(F.col(known_id).alias("one")).distinct(), "one", "left_semi")
    kept = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]).alias("kept"))
    none = F.array().cast(rows.schema[array].dataType)
    return rows.join(kept, "id", "left").withColumn(array, F.coalesce("kept", none)).drop("kept")


def active_counts(places: DataFrame, tasks: DataFrame) -> DataFrame:
    """place_id, name, active: tasks at a place that are neither done nor locked."""
    open_ = tasks.where("status NOT IN ('done', 'locked')").groupBy("location_id").agg(F.count("*").alias("active"))
    return places.join(open_, F.col("place_id") == F.col("location_id"), "left").select("place_id", "name", F.coalesce("active", F.lit(0)).alias("active"))


def names_containing(names: DataFrame, known: DataFrame, name: str, other: str, small: int = SMALL) -> DataFrame:
    """The distinct names with every row of `known` whose own name (`other`) holds the name or is held by it.

    A table of at most `small` rows is broadcast. Beyond, each side is asked for all substrings of the other side's lengths, so
    the join is one of equal strings."""
    asked = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("a", text_key(F.col(name))).where("a <> ''")
    held = known.withColumn("b", text_key(F.col(other))).where("b <> ''")
    if known.limit(small + 1).count() <= small:
        return asked.join(F.broadcast(held), F.contains("a", "b") | F.contains("b", "a")).drop("a", "b")

    def parts(text: str, lengths: list[int]):
        """All distinct substrings of the given lengths."""
        none = F.array().cast("array<string>")

        def of_length(n: int):
            return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(none)

        every = [none, *map(of_length, lengths)]
        return F.explode(F.array_distinct(F.concat(*every)))

    def lengths(rows: DataFrame, column: str) -> list[int]:
        return sorted(r["n"] for r in rows.select(F.length(column).alias("n")).distinct().collect())  # as many as a name is long

    inner = asked.select(name, parts("a", lengths(held, "b")).alias("b")).join(held, "b").drop("b")
    outer = held.select(*known.columns, F.col("b").alias("whole"), parts("b", lengths(asked, "a")).alias("a")).where("a <> whole").join(asked, "a")
    return inner.select(name, *known.columns).unionAll(outer.select(name, *known.columns))


def name_matches(names: DataFrame, places: DataFrame, name: str, place: str, order: str, small: int = SMALL) -> DataFrame:
    """Each name's first place, by `order`, where either holds the other."""
    met = names_containing(names, places.select(place, order), name, place, small)
    return met.groupBy(name).agg(F.min_by(place, order).alias(place), F.min(order).alias(order))


def unlocked_children(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """tasks without those that are gone (gone: id); their direct children lose the parent and, if locked, become available."""
    parents = gone.select(F.col("id").alias("gone_id"))
    left = tasks.join(parents, F.col("id") == F.col("gone_id"), "left_anti")
    marked = left.join(parents, F.col("parent_id") == F.col("gone_id"), "left")
    orphan = F.col("gone_id").isNotNull()
    return marked.withColumn("status", F.when(orphan & (F.col("status") == "locked"), "available").otherwise(F.col("status"))).withColumn("parent_id", F.when(~orphan, F.col("parent_id"))).drop("gone_id")


def coarse_events(events: DataFrame) -> DataFrame:
    """What a model may see of events: no places, and no summary of a location event."""
    return events.select("id", "kind", "start_ts", "end_ts", F.when(F.col("kind") != "location", F.col("title")).alias("title"))


def hidden_values(values):
    """A map without keys that tell an address or a position; a place tag stays."""
    return F.map_filter(values, lambda k, v: (k == "placeTag") | ~F.lower(k).rlike("address|addr|latitude|longitude|coordinate|location|place|street|^lat$|^lng$|^lon$|gps"))
