import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions.columns import conversation_kind
from chatloom.operators import links, merge, persons, tasks
from chatloom.plans import queries
from chatloom.sources import adapted


def test_names_of_large_tables_match_like_small_ones(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    names = spark.createDataFrame([(w,) for w in words[:40]] + [(None,), (" ",)], "name string")
    known = spark.createDataFrame([(w, i) for i, w in enumerate(words[20:])] + [("", 99), (None, 98)], "other string, n int")
    small, large = (sorted(map(tuple, links.names_containing(names, known, "name", "other", limit).collect())) for limit in (10_000, 0))
    assert small == large and small


def test_candidates_fold_like_one_after_another(spark):
    """The whole fold against a plain loop over all candidates, null ones included."""
    rows = adapted.candidate(spark, "/root/testdata/sf0.001")
    nulls = rows.limit(3).withColumn("id", F.concat(F.lit("null-"), "id")).withColumn("ord", F.col("ord") + 10**7)
    nulls = nulls.withColumn("title", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    rows = rows.unionByName(nulls)
    keyed = sorted(merge.keyed(rows).collect(), key=lambda r: r.ord)
    held = []
    for r in keyed:
        place = "".join(c for c in (r.place or "").lower() if c.isalnum())
        for h in held:
            if r.start_at and h["start"] and r.start_at[:10] != h["start"][:10]:
                continue
            if place and h["place"] and place not in h["place"] and h["place"] not in place and r.location_precision == h["precision"] == "exact":
                continue
            same = (r.t == h["t"]) + (r.d == h["d"])
            if same == 2 or (same == 1 and r.source_id in h["sources"]):
                h["n"] += 1
                if r.source_id not in h["sources"] and len(h["sources"]) < 30:
                    h["sources"].append(r.source_id)
                h["start"] = h["start"] or r.start_at
                if len(r.description or "") > len(h["text"]):
                    h["text"], h["d"] = r.description, r.d
                order = ["unknown", "approximate", "exact"]
                if (not h["place"] and place) or order.index(r.location_precision) > order.index(h["precision"]):
                    h["place"], h["precision"] = place, r.location_precision
                break
        else:
            held.append({"id": r.id, "t": r.t, "d": r.d, "text": r.description or "", "start": r.start_at, "place": place, "precision": r.location_precision, "sources": [r.source_id], "n": 0})
    got = sorted(map(tuple, merge.merged_candidates(rows).collect()))
    assert got == sorted((h["id"], h["n"], ",".join(h["sources"])) for h in held)
    assert len([h for h in held if h["n"]]) > 20 and sum(h["id"].startswith("null-") for h in held) == 3


def test_a_hot_title_gives_few_links(spark):
    rows = spark.range(2000).selectExpr("concat('c', id) AS id", "id AS ord", "'Same' AS title", "'text' AS description", "concat('m', id % 5) AS source_id", "CAST(NULL AS STRING) AS start_at", "'Hall' AS place", "'exact' AS location_precision")
    found = merge.duplicate_pairs(rows).collect()
    assert len(found) < 2 * 2000 and {r.second for r in found} == {f"c{i}" for i in range(1, 2000)}


def test_predicates(spark):
    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)

    due = rows("m string, t boolean, p int, n int", ("time", True, 0, 5), ("time", False, 99, 5), ("message-count", True, 4, 5), ("message-count", False, 5, 5), ("either", False, 49, 0), ("either", False, 50, 0), ("either", True, 0, -3))
    assert [r.v for r in due.select(tasks.due(*map(F.col, "mtpn")).alias("v")).collect()] == [True, False, False, True, False, True, True]
    may = rows("a boolean, b boolean, c boolean", (False, False, False), (True, False, False), (False, True, False), (False, False, True))
    assert [r.v for r in may.select(tasks.may_consolidate(*map(F.col, "abc")).alias("v")).collect()] == [True, False, False, False]
    fresh = rows("e string, lp string, la string, h boolean, rp string, ra string", ("x", "x", "2", True, "x", None), ("x", None, None, False, "y", "1"), ("x", "y", "9", True, "x", "1"), ("x", "x", "1", True, "y", "9"), ("x", "x", None, True, "x", "1"), ("x", "x", "1", True, "x", "2"), (None, "x", "2", True, "x", "1"))
    assert [r.v for r in fresh.select(tasks.remote_is_fresher(*map(F.col, ("e", "lp", "la", "h", "rp", "ra"))).alias("v")).collect()] == [False, True, True, False, True, True, False]


def test_the_last_place_stays(spark):
    moved = spark.createDataFrame([("a", 1), ("b", 2)], "id string, location_id long")
    for places, gone, want in (([(1, "x")], 1, [1, 2]), ([(1, "x"), (2, "y"), (3, "z")], 1, [2, 2]), ([(2, "y"), (3, "z")], 1, [1, 2])):
        got = tasks.place_removed(moved, spark.createDataFrame(places, "place_id long, name string"), gone).orderBy("id").collect()
        assert [r.location_id for r in got] == want


@pytest.mark.parametrize("mode,want", [("recent", ["b", "a", "d", "c"]), ("coverage", ["d", "a", "b", "c"]), ("name", ["a", "b", "c", "d"])])
def test_people_in_order(spark, mode, want):
    people = spark.createDataFrame([("a", "2024-01-01", 3, 1), ("b", "2024-02-01", 2, 1), ("c", None, 1, 1), ("d", None, 3, 2)], "name string, last_ts string, sources int, conversations int")
    assert [r.name for r in persons.ordered(people, mode).collect()] == want


def test_ensemble_plan_cuts_direct_conversations(spark):
    """Against a fold in Python over every direct conversation and both extractors."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["ensemble_plan"](spark, sf).collect()
    rows = queries.keyed(spark, sf).withColumn("own", conversation_kind()).withColumn("size", queries.row_size()).collect()
    by_key = {}
    for r in sorted(rows, key=lambda r: (r.captured_ts is None, str(r.captured_ts), r.id)):
        by_key.setdefault(r.key, []).append(r)
    want = []
    for who, most, limit in (("x", 2, 1500), ("y", 5, 9000)):
        for key, messages in by_key.items():
            if messages[0].own != "direct":
                continue
            cuts, used = [], 0
            for r in messages:
                if not cuts or cuts[-1] >= most or used + r.size > limit:
                    cuts, used = [*cuts, 0], 0
                cuts[-1], used = cuts[-1] + 1, used + r.size
            want += [(who, key, i + 1, n) for i, n in enumerate(cuts)]
    assert sorted((r.participant, r.key, r.segment, r.rows) for r in got) == sorted(want) and want
