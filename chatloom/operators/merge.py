"""Merging: three-way states, retained rows, and candidates that are one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import compact_key, trimmed
from chatloom.sources.staging import staged


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, value: str) -> DataFrame:
    """id, value, side: a side that deleted wins, a local addition or edit overrides, else the remote row stands."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.col(value).alias(f"{name}_value"), F.lit(True).alias(f"in_{name}"))

    every = side(base, "base").join(side(local, "local"), "id", "full").join(side(remote, "remote"), "id", "full")
    has = {n: F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in ("base", "local", "remote")}
    deleted = has["base"] & (~has["local"] | ~has["remote"])
    edited = has["local"] & (~has["base"] | ~F.col("base_value").eqNullSafe(F.col("local_value")))
    picked = F.when(edited, F.lit("local")).when(has["remote"], F.lit("remote"))
    out = every.where(~deleted).withColumn("side", picked).where("side IS NOT NULL")
    return out.select("id", F.when(F.col("side") == "local", F.col("local_value")).otherwise(F.col("remote_value")).alias(value), "side")


def three_way_set(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The remote set with the local side's removals and additions."""
    return remote.subtract(base.subtract(local)).union(local.subtract(base)).distinct()


def three_way_map(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Maps as rows (id, value): keys the local side removed go, those it added or changed override, the others are remote."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.col("value").alias(f"{name}_value"), F.lit(True).alias(f"in_{name}"))

    every = side(base, "base").join(side(local, "local"), "id", "full").join(side(remote, "remote"), "id", "full")
    gone = F.col("in_base").isNotNull() & F.col("in_local").isNull()
    changed = F.col("in_local").isNotNull() & (F.col("in_base").isNull() | ~F.col("base_value").eqNullSafe(F.col("local_value")))
    return every.where(~gone & (changed | F.col("in_remote").isNotNull())).select("id", F.when(changed, F.col("local_value")).otherwise(F.col("remote_value")).alias("value"))


def manual_kept(imported: DataFrame, now: DataFrame, manual: Column) -> DataFrame:
    """An import that replaces everything but rows made by hand."""
    kept = now.where(manual)
    return kept.unionByName(imported.join(kept.select("id"), "id", "left_anti"))


#: What two candidates say that may keep them apart, and the key of the place.
SAID = ("start_at", "place", "location_precision", "p")


def conflicts(a: str, b: str) -> Column:
    """Whether two candidates (struct columns of SAID) name different days, or exact places of which neither refines the other."""
    day = F.col(f"{a}.start_at").isNotNull() & F.col(f"{b}.start_at").isNotNull() & (F.substring(f"{a}.start_at", 1, 10) != F.substring(f"{b}.start_at", 1, 10))
    p, q = F.col(f"{a}.p"), F.col(f"{b}.p")
    refines = F.contains(p, q) | F.contains(q, p)
    both = (F.col(f"{a}.location_precision") == "exact") & (F.col(f"{b}.location_precision") == "exact")
    return day | ((p != "") & (q != "") & ~refines & both)


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    """first, second, link: candidates that are the same task. Both keys equal, or one equal and a message cited by both.

    Candidates that agree in all that is compared are a class, whose first is its representative: links of kind `member` name
    it for the others, and links of kind `same` are between representatives. So a title that many have gives no pair for
    each two of them. Classes meet by (title and description), by (source and title) or by (source and description)."""
    rows = staged(keyed(candidates).select("id", "ord", "t", "d", "source_id", *SAID), "candidates")
    same = F.lit(True)
    for c in SAID:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    first = staged(rows.groupBy("t", "d", "source_id", *SAID).agg(F.min_by("id", "ord").alias("first"), F.min("ord").alias("ord")), "candidate_classes")
    of = first.select("t", "d", "source_id", *[F.col(c).alias(f"first_{c}") for c in SAID], "first")
    members = rows.join(of, ["t", "d", "source_id"]).where(same & (F.col("first") != F.col("id"))).select("first", F.col("id").alias("second"), F.lit("member").alias("link"))
    met = None
    for keys in (["t", "d"], ["source_id", "t"], ["source_id", "d"]):
        # of what these keys and the sayings do not tell apart, one class speaks for all; the others are linked to it
        alike = first.groupBy(*keys, *SAID).agg(F.min_by("first", "ord").alias("id"), F.min("ord").alias("ord"))
        one = alike.select(*keys, F.struct("id", "ord", *SAID).alias("a"))
        two = alike.select(*keys, F.struct("id", "ord", *SAID).alias("b"))
        across = one.join(two, keys).where("a.ord < b.ord").where(~F.coalesce(conflicts("a", "b"), F.lit(False))).select(F.col("a.id").alias("first"), F.col("b.id").alias("second"))
        spoken = alike.select(*keys, *[F.col(c).alias(f"first_{c}") for c in SAID], F.col("id").alias("speaker"))
        within = first.join(spoken, keys).where(same & (F.col("first") != F.col("speaker"))).select(F.col("speaker").alias("first"), F.col("first").alias("second"))
        part = across.unionAll(within)
        met = part if met is None else met.unionAll(part)
    return met.distinct().select("first", "second", F.lit("same").alias("link")).unionAll(members)


def keyed(candidates: DataFrame) -> DataFrame:
    """candidates with t and d, the keys of title and description, and p, the key of the place. A null title or description has a
    key of its own, so it equals no other. Keys are only compared for being equal, so t and d are 128-bit digests: what is
    shuffled by them does not grow with the texts."""
    own = F.concat(F.lit("\0"), F.col("id"))

    def digested(text: str) -> Column:
        return F.substring(F.unhex(F.sha2(F.coalesce(compact_key(F.col(text)), own), 256)), 1, 16)

    return candidates.withColumns({"t": digested("title"), "d": digested("description"), "p": compact_key(F.coalesce("place", F.lit("")))})


#: Candidates that are folded as one block.
SMALL = 1 << 15
#: A description under more titles than this keeps all its candidates together, instead of looking at each title.
TITLES = 64


def _several(name: str) -> Column:
    """Whether a group has several values of a column besides null. Told by two hashes: greatest and least of numbers need no sort."""
    hashes = [F.when(F.col(name).isNotNull(), h) for h in (F.xxhash64(name), F.xxhash64(F.lit("again"), name))]
    return (F.min(hashes[0]) < F.max(hashes[0])) | (F.min(hashes[1]) < F.max(hashes[1]))


def _blocks(rows: DataFrame) -> DataFrame:
    """own (the hash of an id), block of the candidates that may have to do with another, so that no cluster of the fold leaves
    its block. rows: id, t, d, s (the source or null), day (or null).

    A cluster has its first candidate's title and one of its titled candidates' descriptions, and takes sources from
    candidates of both. So who joins it shares title and description, or title and source, with a candidate of it, or a
    description with one and a source with another of its title (`indirect`). Days that differ never meet, so a pair of keys
    counts by the day, unless a candidate without a day has it. Many rows of one title are thus as many blocks as their
    descriptions, sources and days part them into."""
    titles = rows.groupBy("t").agg(_several("d").alias("more"), _several("s").alias("said")).where("more AND said").select("t")
    of_titles = rows.join(titles, "t", "left_semi")
    described = of_titles.select("t", "d").distinct()
    crowded = described.groupBy("d").agg(F.count("*").alias("titles"))
    shared = rows.groupBy("d").agg(_several("t").alias("several")).where("several").select("d")
    crowded = crowded.join(shared, "d", "left_semi")
    few = described.join(crowded.where(F.col("titles") <= TITLES), "d", "left_semi").withColumnRenamed("t", "other")
    meets = rows.where("s IS NOT NULL").select("d", "s", "t").distinct().join(few, "d").where("t <> other").select("d", "s", F.col("other").alias("t"))
    indirect = meets.join(of_titles.select("t", "s").distinct(), ["t", "s"], "left_semi").select("d")
    wide = indirect.unionAll(crowded.where(F.col("titles") > TITLES).select("d")).distinct().withColumn("wide", F.lit(True))

    def key(kind: str, *names: str) -> Column:
        return F.when(F.col(names[-1]).isNotNull(), F.xxhash64(F.lit(kind), *names))

    keys = F.array(key("td", "t", "d"), key("ts", "t", "s"), key("ds", "d", "s"), F.when(F.col("wide"), key("d", "d")))
    each = rows.join(wide, "d", "left").select(F.xxhash64(F.lit("row"), "id").alias("own"), "day", F.explode(F.array_compact(keys)).alias("key"))
    met = each.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(F.col("day").isNull()).alias("open")).where("n > 1").select("key", "open")
    nodes = each.join(met, "key").select("own", F.when(F.col("open"), F.col("key")).otherwise(F.xxhash64("key", "day")).alias("node"))
    of = staged(nodes.groupBy("own").agg(F.array_sort(F.collect_set("node")).alias("nodes")), "nodes")  # four at most
    from chatloom.operators.blocks import connected

    # a candidate links its keys, so the graph is of keys alone
    labels = connected(of.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")))
    return of.select("own", F.col("nodes")[0].alias("node")).join(labels, "node").select("own", "block")


class _Held:
    """The merged candidates of one block, found by what a candidate may share with them."""

    def __init__(self):
        self.all: list[dict] = []
        self.by: dict[tuple, list[int]] = {}

    def note(self, n: int, sources: list[str]) -> None:
        h = self.all[n]
        for key in (("td", h["t"], h["d"]), *(x for s in sources for x in (("ts", h["t"], s), ("ds", h["d"], s)))):
            self.by.setdefault(key, []).append(n)

    def first(self, r: dict) -> dict | None:
        """The first of them that r equals."""
        found = None
        s = r["source_id"]
        for key in (("td", r["t"], r["d"]), *((("ts", r["t"], s), ("ds", r["d"], s)) if s is not None else ())):
            for n in self.by.get(key, ()):
                if (found is None or n < found) and self._same(r, self.all[n], key[0]):
                    found = n
        return found

    def _same(self, r: dict, h: dict, kind: str) -> bool:
        if kind != "ts" and r["d"] != h["d"]:  # it has had that description, but no longer
            return False
        if r["day"] and h["day"] and r["day"] != h["day"]:
            return False
        p, q = r["place"], h["place"]
        return not (p and q and p not in q and q not in p and r["precision"] == h["precision"] == 2)

    def take(self, r: dict) -> dict | None:
        """The merged candidate that r becomes part of, or None if none before it is equal and it begins its own."""
        n, s = self.first(r), r["source_id"]
        if n is None:
            self.all.append(r | {"members": 1, "sources": [] if s is None else [s]})
            self.note(len(self.all) - 1, self.all[-1]["sources"])
            return None
        h = self.all[n]
        h["members"] += 1
        h["day"] = h["day"] or r["day"]
        if (not h["place"] and r["place"]) or r["precision"] > h["precision"]:
            h["place"], h["precision"] = r["place"], r["precision"]
        if r["length"] > h["length"]:
            other, h["length"], h["d"] = r["d"] != h["d"], r["length"], r["d"]
            if other:
                self.note(n, h["sources"])
        if s is not None and s not in h["sources"] and len(h["sources"]) < 30:
            h["sources"].append(s)
            self.note(n, [s])
        return h


def folded(candidates: DataFrame, small: int = SMALL, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, head, absorbed, sources: every candidate and the one that it is merged into (itself: then with how many others it
    took and its sources; else both are null), folded in the order of ord; each joins the first earlier one that it equals. Every
    row brings the columns `carried` along, so that they need not be joined to the result.

    Being equal is not transitive and a merged candidate gathers sources, so the order counts within a block (`_blocks`), whose
    rows are streamed and looked up by what they share; blocks are folded apart from each other. A candidate that shares
    nothing is in no block. Up to `small` candidates are one block, which costs less than parting them. Null or unknown
    precisions are `unknown`, a null source is none."""
    rows = keyed(candidates).select(
        "id",
        "ord",
        "t",
        "d",
        F.length(F.coalesce("description", F.lit(""))).alias("length"),
        F.col("source_id").alias("s"),
        F.substring(F.nullif("start_at", F.lit("")), 1, 10).alias("day"),
        F.col("p").alias("place"),
        F.when(F.col("location_precision") == "exact", 2).when(F.col("location_precision") == "approximate", 1).otherwise(0).alias("precision"),
        *carried,
    )
    rows = staged(rows, "candidates")
    if rows.limit(small + 1).count() <= small:
        parted = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        parted = rows.withColumn("own", F.xxhash64(F.lit("row"), "id")).join(_blocks(rows), "own", "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, _Held()
        columns = ["id", "head", "absorbed", "sources", *carried]

        def heads() -> list[tuple]:
            return [(h["id"], h["id"], h["members"] - 1, ",".join(h["sources"]), *[h[c] for c in carried]) for h in held.all]

        for batch in batches:
            done = []
            for values in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
                r = dict(zip(batch.columns, values, strict=True))
                if r["block"] != at:
                    done += heads()
                    at, held = r["block"], _Held()
                head = held.take(r)
                if head is not None:
                    done.append((r["id"], head["id"], None, None, *[r[c] for c in carried]))
            yield pd.DataFrame(done, columns=columns).astype({"absorbed": "Int64"})
        yield pd.DataFrame(heads(), columns=columns).astype({"absorbed": "Int64"})

    narrow = parted.where("block IS NOT NULL").select("block", "ord", "id", "t", "d", "length", F.col("s").alias("source_id"), "day", "place", "precision", *carried)
    made = ["id string, head string, absorbed long, sources string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carried).schema]]
    several = narrow.repartition("block").sortWithinPartitions("block", "ord", "id").drop("ord").mapInPandas(fold, ", ".join(made))
    alone = parted.where("block IS NULL").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("absorbed"), F.coalesce("s", F.lit("")).alias("sources"), *carried)
    return several.unionAll(alone)


def merged_candidates(candidates: DataFrame, small: int = SMALL) -> DataFrame:
    """id, absorbed, sources: the merged candidates (see folded), how many others each took, and its first 30 sources."""
    return folded(candidates, small).where("absorbed IS NOT NULL").select("id", "absorbed", "sources")


def adjudicated(observations: DataFrame, extractors: int) -> DataFrame:
    """candidate, passes, models, agreement of merged candidates: how many passes and models saw one of its members. One
    extractor: single; two passes or more: consensus; else needs-review. observations: candidates with pass_id and model;
    those without a pass take no part."""
    rows = observations.where(trimmed("pass_id") != "").withColumn("model", F.nullif(trimmed("model"), F.lit("")))
    told = F.lit("single") if extractors <= 1 else F.when(F.col("passes") >= 2, "consensus").otherwise("needs-review")
    # both are counted over one reading of the fold; Spark makes rows distinct by candidate and value first, so that a candidate
    # with many members is no group of their rows
    members = folded(rows, carried=("pass_id", "model")).withColumnRenamed("head", "candidate")
    counted = members.groupBy("candidate").agg(F.count_distinct("pass_id").alias("passes"), F.count_distinct("model").alias("models"))
    return counted.select("candidate", "passes", "models", told.alias("agreement"))
