from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.operators import segments as S


def model(sizes, core_rows, core_size, overlap_rows, overlap_size):
    cuts, at = [], 0
    while at < len(sizes):
        end, used = at, 0
        while end < len(sizes) and (end == at or (end - at < core_rows and used + sizes[end] <= core_size)):
            used, end = used + sizes[end], end + 1
        n = used = 0
        while n < min(overlap_rows, at) and (n == 0 or used + sizes[at - n - 1] <= overlap_size):
            used, n = used + sizes[at - n - 1], n + 1
        cuts.append((at, end, n))
        at = end
    return cuts


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=30), min_size=1, max_size=5), st.integers(1, 6), st.integers(10, 150), st.integers(0, 4), st.integers(5, 90), st.sampled_from([6, 7, 4096]))
def test_against_a_model(spark, conversations, core_rows, core_size, overlap_rows, overlap_size, block):
    budget = dict(core_rows=core_rows, core_size=core_size, overlap_rows=overlap_rows, overlap_size=overlap_size)
    rows = spark.createDataFrame([(f"c{c}", i, s) for c, sizes in enumerate(conversations) for i, s in enumerate(sizes)], "key string, at int, size int")
    cut = S.segments(S.placed(rows, "key", [F.col("at")]), "key", "size", **budget, block=block)
    want = {(f"c{c}", k + 1): x for c, sizes in enumerate(conversations) for k, x in enumerate(model(sizes, **budget))}
    got = {(r.key, r.segment): r["count"] for r in cut.groupBy("key", "segment").count().collect()}
    assert got == {k: end - at for k, (at, end, _) in want.items()}
    assert {(r.key, r.segment): (r.first_place, r.overlap) for r in S.overlaps(cut, "key", "size", **budget).collect()} == {k: (at, n) for k, (at, _, n) in want.items()}


def test_ranges(spark):
    rows = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 9, 10, 2)] + [(2, 5)], "k int, n int")
    assert {r.k: r.ranges for r in S.ranges(rows, "n", "k").collect()} == {1: "1-3, 7, 9-10", 2: "5"}


def test_places_of_a_long_key(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('k', id % 10) END AS key", "(id * 7919) % 5003 AS at", "id")
    got = S.placed(rows.repartition(7), "key", [F.col("at"), F.col("id")]).selectExpr("key", "place", "row_number() OVER (PARTITION BY key ORDER BY at, id) - 1 AS want")
    assert got.count() == 5000 and got.where("place <> want").count() == 0


def test_one_long_conversation_over_many_blocks(spark):
    sizes = [(i * 37) % 61 + 1 for i in range(3000)]
    rows = spark.createDataFrame([("c", i, s) for i, s in enumerate(sizes)], "key string, place long, size int")
    got = {(r.segment): (r.a, r.n) for r in S.segments(rows, "key", "size", 9, 200, block=16).groupBy("segment").agg(F.min("place").alias("a"), F.count("*").alias("n")).collect()}
    assert got == {k + 1: (at, end - at) for k, (at, end, _) in enumerate(model(sizes, 9, 200, 0, 0))}
