import random

from chatloom.operators import blocks, persons

SCHEMA = "id string, ord int, name string, source_ids array<string>, keys array<string>, first_ts string, last_ts string, avatar string"


def cards(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def plain(people):
    return sorted((r.person, r.name, r.cards, r.sources, tuple(r["keys"]), r.first_ts, r.last_ts, r.avatar) for r in people.collect())


def drawn(seed, n, first=0):
    rng = random.Random(seed)
    some = lambda letters, most: [rng.choice(letters) + str(rng.randrange(30)) for _ in range(rng.randrange(most))] if rng.random() < 0.85 else None
    return [(f"p{first + i}", first + i, rng.choice(["Ann", "ann ", "Bo", "Cy", None, "", "!!"]), some("s", 3), some("k", 3), f"2024-01-{rng.randrange(10, 28)}", None, rng.choice([None, f"a{i}"])) for i in range(n)]


def test_no_card_is_lost(spark):
    data = [("a", 1, "Ann", None, ["k"], None, None, None), ("b", 2, None, ["s"], ["k"], None, None, None), ("c", 3, "Ann", ["s"], None, None, None, None), ("d", 4, "Ann", ["s", None], ["k", None], None, None, None), ("e", 5, " ", [], [], None, None, None), ("e2", 6, None, ["s"], ["k"], None, None, None)]
    got = persons.merged(cards(spark, data)).collect()
    assert sorted((r.person, r.cards) for r in got) == [("a", 3), ("b", 1), ("e", 1), ("e2", 1)]
    assert persons.merged(cards(spark, [])).collect() == []
    assert sum(r.cards for r in persons.merged(cards(spark, drawn(1, 200))).collect()) == 200


def test_dismissed_and_restored(spark):
    data = cards(spark, [("a", 1, "Ann", [], ["k"], None, None, None), ("b", 2, "Bo", [], ["l"], None, None, None), ("c", 3, "Cy", [], None, None, None, None)])
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    assert [r[0] for r in plain(persons.merged(data, keys("k", "l")))] == ["c"]
    assert [r[0] for r in plain(persons.merged(data, keys("k", "l"), keys("l", "q")))] == ["b", "c"]


def test_increments_equal_merging_all(spark):
    for seed in (1,):
        parts = [drawn(seed, 120), drawn(seed + 10, 40, 120), drawn(seed + 20, 40, 160)]
        state = persons.begun(cards(spark, parts[0]))
        for part in parts[1:]:
            before = {r.person: r for r in state.people.collect()}
            state, touched = persons.joined(state, cards(spark, part + parts[0][:5]))
            reached = {r.block for r in touched.collect()} | {r.was for r in touched.collect()}
            after = {r.person: r for r in state.people.collect()}
            assert all(after[p] == r for p, r in before.items() if r.block not in reached)
            assert any(r.block not in reached for r in before.values())
        assert plain(state.people) == plain(persons.merged(cards(spark, sum(parts, []))))
        assert {(r.node, r.block) for r in state.labels.collect()} == {(r.node, r.block) for r in blocks.connected(persons.edges(state.cards)).collect()}


def test_nothing_joins(spark):
    state = persons.begun(cards(spark, [("a", 1, "Ann", ["s"], ["k"], None, None, None)]))
    same, touched = persons.joined(state, cards(spark, []))
    assert touched.collect() == [] and plain(same.people) == plain(state.people)


def test_portraits_end_with_their_evidence(spark):
    portraits = spark.createDataFrame([("a", "1", 2), ("b", "1", 1), ("gone", "1", 0), ("new", None, None), ("quiet", "1", 1)], "person string, signature string, retries int")
    people = spark.createDataFrame([("a",), ("b",), ("new",), ("quiet",)], "person string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("new", "3")], "person string, signature string")
    got = {r.person: (r.signature, r.retries, r.state) for r in persons.portraits_kept(portraits, people, now).collect()}
    assert got == {"a": ("1", 2, "ready"), "b": (None, 0, "processing"), "new": (None, 0, "processing"), "quiet": (None, 0, "processing")}


def test_a_position_half_way_is_rounded_as_its_decimals_are(spark, tmp_path):
    from chatloom.plans.workflow_queries import distinct_places

    # 0.0000450 and 0.0000516 are both 0.00005; a product of doubles makes the first one less than half
    spark.createDataFrame([(450, 17), (516, 17)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [(r["query"], r["rank"]) for r in distinct_places(spark, str(tmp_path)).collect()] == [(17, 450)]
