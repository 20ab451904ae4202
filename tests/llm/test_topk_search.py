import math
import random

import pytest

from chatloom.llm import topk_search as T


def brute(rows, every, k):
    """Every row is a candidate of every query but itself; scores beyond 64 bits are cut after ranking."""
    whole = [(n, [math.floor(1024 * v) if abs(v) < 2.0**60 else int(v) * 1024 for v in x]) for n, x in rows if n is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i, (q, x) in enumerate(whole):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), n) for j, (n, y) in enumerate(whole) if i != j and len(y) == len(x))
            out += [(q, r + 1, n, min(2**63 - 1, max(-(2**63), -s))) for r, (s, n) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(n, x, "c", 3) for n, x in rows], f"vec_id long, embedding array<{kind}>, score string, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(df, every=10, k=5, **kw).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], 10, 5)
    return got


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 90, "wave": 9}])
def test_against_brute_force(spark, kw):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [0.25] * 8) for i in range(150)]
    rows += [(1000, None), (1010, [None] * 8), (1020, [float("nan")] * 8), (1030, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(1050, [0.5] * 4), (1051, [0.25] * 4), (1060, []), (1061, []), (1070, [0.1] * 3), (20, [9.0] * 8), (21, rows[21][1]), (30, rows[30][1]), (30, rows[30][1])]
    assert check(spark, rows, **kw)


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 50, "wave": 9}])
def test_large_components(spark, kw):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([1, 1e4, 7e4, 1e9, 1e20, 1e37]) for _ in range(6)]) for i in range(200)]
    rows += [(300 + i, [70000.0] * 6) for i in range(20)] + [(400, [-3e38] * 6), (401, [3e38] * 6), (402, [3e38] * 6)]
    assert check(spark, rows, **kw)
    assert check(spark, [(100, [1.0, 1.0]), (1, [70000.0, 1.0]), (2, [3.0, 1.0]), (2, [9.0, 9.0])], **kw)[0][2] == 1


def test_components_at_the_end_of_doubles(spark):
    rng = random.Random(4)
    assert check(spark, [(i, [rng.uniform(-1, 1) * rng.choice([1.0, 1e307, 1e308, 1e160]) for _ in range(4)]) for i in range(150)], kind="double", shard_rows=60)


def test_repeated_rows(spark):
    assert check(spark, [(10, [0.5, 0.5])] * 30 + [(11, [0.5, 0.5])] * 30)


def test_no_rows(spark):
    assert check(spark, []) == []
