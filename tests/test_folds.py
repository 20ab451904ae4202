"""Folds and frames that no longer hang on one task, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom.operators import blocks, evidence, gates, links, merge, records, segments, tasks
from chatloom.sources.staging import staged

CANDIDATE = "id string, ord long, title string, description string, source_id string, start_at string, place string, location_precision string"


def one_after_another(keyed):
    """head, sources: each candidate joins the first earlier one that it equals."""
    held, head = [], {}
    rank = {"unknown": 0, "approximate": 1, "exact": 2}
    for r in sorted(keyed, key=lambda r: r.ord):
        place = "".join(c for c in (r.place or "").lower() if c.isalnum())
        precision = rank.get(r.location_precision, 0)
        for h in held:
            if r.start_at and h["start"] and r.start_at[:10] != h["start"][:10]:
                continue
            if place and h["place"] and place not in h["place"] and h["place"] not in place and precision == h["precision"] == 2:
                continue
            same = (r.t == h["t"]) + (r.d == h["d"])
            if same == 2 or (same == 1 and r.source_id is not None and r.source_id in h["sources"]):
                if r.source_id is not None and r.source_id not in h["sources"] and len(h["sources"]) < 30:
                    h["sources"].append(r.source_id)
                h["start"] = h["start"] or r.start_at
                if len(r.description or "") > len(h["text"]):
                    h["text"], h["d"] = r.description, r.d
                if (not h["place"] and place) or precision > h["precision"]:
                    h["place"], h["precision"] = place, precision
                head[r.id] = h["id"]
                break
        else:
            held.append({"id": r.id, "t": r.t, "d": r.d, "text": r.description or "", "start": r.start_at, "place": place, "precision": precision, "sources": [] if r.source_id is None else [r.source_id]})
            head[r.id] = r.id
    return head, {h["id"]: ",".join(h["sources"]) for h in held}


def drawn(seed, n, titles=3, texts=4, sources=5):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    return [
        (
            f"c{i}",
            i,
            some(None, "", *(f"Title {k}" for k in range(titles))),
            some(None, "", *("text " * (1 + k) for k in range(texts))),
            some(None, *(f"m{k}" for k in range(sources))),
            some(None, "", "2024-01-01T10:00", "2024-01-01", "2024-01-02"),
            some(None, "", "Hall", "Hall North", "Attic"),
            some(None, "unknown", "approximate", "exact", "exactly"),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"titles": 12, "texts": 9, "sources": 14}), (4, {"titles": 1, "texts": 20, "sources": 12})])
def test_candidates_fold_like_one_after_another(spark, seed, sizes):
    rows = spark.createDataFrame(drawn(seed, 220, **sizes), CANDIDATE).repartition(4)
    head, sources = one_after_another(merge.keyed(rows).collect())
    assert {r.id: r.head for r in merge.folded(rows).collect()} == head
    found = staged(merge.folded(rows, small=0), "folded")
    got = found.collect()
    assert {r.id: r.head for r in got} == head and len(got) == len(head)
    assert {r.id: r.sources for r in got if r.id == r.head} == sources
    assert {r.id: r.absorbed for r in got if r.id == r.head} == {h: sum(x == h for x in head.values()) - 1 for h in sources}


def test_titles_beyond_the_limit_fold_alike(spark, monkeypatch):
    monkeypatch.setattr(merge, "TITLES", 1)
    rows = spark.createDataFrame(drawn(5, 150, titles=9, texts=6, sources=8), CANDIDATE)
    assert {r.id: r.head for r in merge.folded(rows, small=0).collect()} == one_after_another(merge.keyed(rows).collect())[0]


def test_a_hot_title_is_many_blocks(spark):
    rows = spark.range(900).selectExpr("concat('c', id) AS id", "id AS ord", "'Same' AS title", "concat('text ', id div 3) AS description", "concat('m', id) AS source_id", "CAST(NULL AS STRING) AS start_at", "CAST(NULL AS STRING) AS place", "CAST(NULL AS STRING) AS location_precision")
    keyed = merge.keyed(rows).withColumnRenamed("source_id", "s").withColumn("day", F.col("start_at"))
    assert merge._blocks(keyed).groupBy("block").count().count() == 300
    days = keyed.withColumn("d", F.lit("text")).withColumn("day", F.concat(F.lit("2024-01-"), F.lpad((F.col("ord") % 20 + 10).cast("string"), 2, "0")))
    assert merge._blocks(days).groupBy("block").count().count() == 20
    assert merge.merged_candidates(rows.limit(0)).collect() == []


def test_adjudication(spark):
    rows = [("a", 1, "T", "d", "m1", "p1", "x"), ("b", 2, "T", "d", "m2", "p2", "x"), ("c", 3, "T", "d", "m3", "p2", " "), ("d", 4, "U", "d", "m4", "p1", None), ("e", 5, "V", "e", "m5", " ", "x"), ("f", 6, "W", "e", "m6", None, "x")]
    df = spark.createDataFrame(rows, "id string, ord long, title string, description string, source_id string, pass_id string, model string").withColumns({"start_at": F.lit(None).cast("string"), "place": F.lit(None).cast("string"), "location_precision": F.lit("exact")})
    got = sorted(tuple(r) for r in merge.adjudicated(df, 2).collect())
    assert got == [("a", 2, 1, "consensus"), ("d", 1, 0, "needs-review")]
    assert {r.agreement for r in merge.adjudicated(df, 1).collect()} == {"single"}


def test_adjudication_reads_the_fold_once(spark):
    """Two counts are made of one fold, and what they count comes with it instead of being joined to it."""
    rows = spark.createDataFrame(drawn(10, 80), CANDIDATE).withColumns({"pass_id": F.concat(F.lit("p"), F.col("ord") % 3), "model": F.when(F.col("ord") % 4 > 0, F.concat(F.lit("m"), F.col("ord") % 4))})
    out = merge.adjudicated(rows, 4)
    said = out._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("MapInPandas") == 1 and "Join" not in said
    head, passes, models = one_after_another(merge.keyed(rows).collect())[0], {}, {}
    for r in rows.collect():
        passes.setdefault(head[r.id], set()).add(r.pass_id)
        models.setdefault(head[r.id], set()).update({r.model} - {None})
    assert {r.candidate: (r.passes, r.models) for r in out.collect()} == {h: (len(p), len(models[h])) for h, p in passes.items()}
    brought = merge.folded(rows.withColumn("odd name", F.col("ord")), small=0, carried=("model", "odd name")).collect()
    assert sorted((r.id, r.model, r["odd name"]) for r in brought) == sorted((r.id, r.model, r.ord) for r in rows.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, monkeypatch, kind):
    """The least node of each component; those that a round settles are in none after it."""
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(150)]
    star = [(400, i) for i in range(401, 430)] + [(460, i) for i in range(430, 460)]
    drawn = [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(45)]
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(800)]
    edges = [*chain, *star, *drawn, *pairs, (990, 990)]
    if kind == "string":
        edges = [tuple(f"n{x:04}" for x in e) for e in edges]
    least = {x: x for e in edges for x in e}
    for _ in range(len(chain)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    sizes = []

    def counted(df, name):
        out = staged(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(blocks, "staged", counted)
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    got = blocks.connected(df).collect()
    assert len(got) == len(least) and {r.node: r.block for r in got} == least
    later = [n for name, n in sizes if name == "edges"][1:]
    assert later and max(later) < 80 and len(later) < 8
    assert blocks.connected(df.limit(0)).collect() == []


def test_frames_over_blocks(spark):
    rng = random.Random(4)
    data = [(k, i, rng.random() < 0.1, rng.choice([None, None, i])) for k in ("a", "b", None) for i in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(data, "key string, at int, new boolean, value int").repartition(5)
    by_key = {k: sorted((r for r in data if r[0] == k), key=lambda r: r[1]) for k in ("a", "b", None)}
    near = sorted((str(k), r[1]) for k, rows in by_key.items() for i, r in enumerate(rows) if any(x[2] for x in rows[i : i + 8]))
    for block in (7, 16, 4096):
        got = links.with_context(df, "new", 7, "key", [F.col("at")], block=block)
        assert sorted((str(r.key), r.at) for r in got.collect()) == near and got.columns == df.columns
        filled = {(r.key, r.at): r.value for r in links.carried_forward(df, "value", "key", [F.col("at")], block=block).collect()}
        for k, rows in by_key.items():
            last = None
            for r in rows:
                last = r[3] if r[3] is not None else last
                assert filled[(k, r[1])] == last
    with pytest.raises(ValueError):
        links.with_context(df, "new", 7, "key", [F.col("at")], block=3)


def test_overlaps_over_blocks(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(0, 40) for _ in range(300)]
    df = spark.createDataFrame([("one", i, s) for i, s in enumerate(sizes)], "key string, place long, size int")
    cut = segments.segments(df, "key", "size", core_rows=6, core_size=90, block=16)
    for block in (5, 64):
        got = {r.segment: (r.first_place, r.overlap) for r in segments.overlaps(cut, "key", "size", 5, 60, block=block).collect()}
        for first, n in got.values():
            taken = used = 0
            for s in sizes[max(0, first - 5) : first][::-1]:
                if taken and used + s > 60:
                    break
                taken, used = taken + 1, used + s
            assert n == taken
    assert len(got) > 20


def test_no_exchange_by_the_bare_key(spark):
    """One key is many tasks: frames are by key and block."""
    rows = spark.range(100).selectExpr("concat('r', id) AS id", "timestamp_ntz'2024-01-01 00:00:00' AS captured_ts", "'text' AS content")
    plan = records.self_plan(rows, segments.SELF)
    one = rows.withColumns({"k": F.lit("x"), "new": F.lit(True)})
    framed = [(segments.overlaps(plan, "target", "size", 8, 1000), "target"), (links.with_context(one, "new", 3, "k", [F.col("id")]), "k"), (links.carried_forward(one, "content", "k", [F.col("id")]), "k")]
    for df, key in framed:
        said = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(rf"hashpartitioning\({key}#\d+, \d+", said), said


def test_retention_in_rounds(spark):
    rng = random.Random(8)
    files = [(u, f"f{i:03}", None if rng.random() < 0.03 else f"2024-01-{1 + i % 28:02} 00:00:00", rng.choice([rng.randrange(30), rng.randrange(200), None, 0])) for u in ("a", "b", None, "c") for i in range(rng.randrange(1, 120))]
    df = spark.createDataFrame(files, "user string, name string, at string, bytes long").withColumn("at", F.to_timestamp("at"))
    for most, budget in ((10, 300), (1000, 100), (3, 10_000)):
        want = {}
        for u in ("a", "b", None, "c"):
            own = sorted((f for f in files if f[0] == u), key=lambda f: (f[2] is None, "" if f[2] is None else "".join(chr(200 - ord(c)) for c in f[2]), f[1]))
            kept, used = [], 0
            for _, name, _, size in own:
                if len(kept) < most and used + (size or 0) <= budget:
                    kept.append(name)
                    used += size or 0
            want[u] = (len(kept), used, ",".join(kept))
        for block in (4096, 6):
            assert {r.user: (r.kept, r.bytes, r.names) for r in gates.kept_within(df, most, budget, "user", block=block).collect()} == want


def test_claims_with_many_sources(spark):
    data = [("p", "k", f"m{i:03}", f"2024-01-{1 + i % 28:02} 00:00:00", float(i % 7)) for i in range(400)] + [("p", None, "m1", None, 1.0), ("p", None, "m1", None, 2.0), (None, "k", "m2", "2024-01-01 00:00:00", 0.5)]
    df = spark.createDataFrame(data, "person string, claim string, source_id string, at string, score double").withColumn("observed_ts", F.to_timestamp_ntz("at"))
    got = {(r.person, r.claim): (r.sources, r.n_sources, r.score, r.strength) for r in evidence.merged_claims(df, "person", "claim").collect()}
    first = ",".join(s for _, s in sorted((r[3], r[2]) for r in data[:400])[:12])
    assert got == {("p", "k"): (first, 400, 6.0, "repeated"), ("p", None): ("m1", 1, 2.0, "single"), (None, "k"): ("m2", 1, 0.5, "single")}
    assert "WindowGroupLimit" in evidence.merged_claims(df, "person", "claim")._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_keyed_once(spark):
    """Texts are digested where they are read; what compares candidates works out no keys, and shuffles none that are as long as a text."""
    rows = spark.createDataFrame(drawn(7, 60), CANDIDATE)
    keys = merge.keyed(rows.withColumn("description", F.repeat("description", F.lit(500)))).select("t", "d").collect()
    assert {len(k) for r in keys for k in r} == {16}
    assert "ArrowEvalPython" not in merge.duplicate_pairs(rows)._jdf.queryExecution().executedPlan().toString()


def test_known_candidates_are_keyed_once(spark):
    rows = spark.createDataFrame(drawn(8, 90), CANDIDATE)
    new = tasks.not_known_yet(rows.where("ord % 3 = 0"), rows.where("ord % 3 <> 0"))
    assert new._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1  # of the incoming ones
    keyed, left = merge.keyed(rows).collect(), []
    for a in keyed:
        near = [b for b in keyed if b.ord % 3 and (a.t == b.t) + (a.d == b.d) + (a.source_id is not None and a.source_id == b.source_id) > 1 and (a.t == b.t or a.d == b.d)]
        apart = lambda b: (a.start_at is not None and b.start_at is not None and a.start_at[:10] != b.start_at[:10]) or (a.p and b.p and a.p not in b.p and b.p not in a.p and a.location_precision == b.location_precision == "exact")  # noqa: E731, B023
        if a.ord % 3 == 0 and all(map(apart, near)):
            left.append(a.id)
    assert sorted(r.id for r in new.collect()) == sorted(left) and new.columns == rows.columns and left


def test_descriptions_do_not_go_into_the_fold(spark):
    rows = spark.createDataFrame(drawn(9, 40), CANDIDATE)
    said = merge.folded(rows, small=0)._jdf.queryExecution().analyzed().toString()
    assert "length#" in said and "description#" not in said
