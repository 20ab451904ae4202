import math
import random

import pytest

from chatloom.llm import hard_negatives as H


def brute(rows, every, low=30, high=90):
    whole = [(n, lab, [math.floor(256 * v) if abs(v) < 2.0**60 else int(v) * 256 for v in x]) for n, x, lab in rows if n is not None and lab is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    cut = lambda s: min(2**63 - 1, max(-(2**63), s))
    out = []
    for i, (a, lab, x) in enumerate(whole):
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y, strict=True)), n, m) for j, (n, m, y) in enumerate(whole) if i != j and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scores if r[2] == lab)[:5]:
            within = sorted(r for r in scores if r[2] != lab and low * -s <= 100 * -r[0] <= high * -s)[:10]
            out += [(a, p, k + 1, n, cut(-s), cut(-t)) for k, (t, n, _) in enumerate(within)]
    return sorted(out)


def check(spark, rows, every=10, kind="float", **kw):
    df = spark.createDataFrame([(n, x, lab, 1, "r") for n, x, lab in rows], f"vec_id long, embedding array<{kind}>, label int, rank int, row string")
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in H.hard_negatives(df, every=every, **kw).collect())
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()], every)
    return got


@pytest.mark.parametrize("kw", [{}, {"bucket_rows": 16, "block_rows": 7, "cell_bytes": 3000}])
def test_against_brute_force(spark, kw):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.1, 0.3) * rng.choice([1, 1, 3]) for _ in range(8)], rng.randrange(4)) for i in range(400)]
    rows += [(400 + i, [0.25] * 8, i % 3) for i in range(120)]
    rows += [(1000, None, 1), (1010, [None] * 8, 1), (1020, [float("nan")] * 8, 2), (1030, [float("inf")] * 8, 3), (None, [0.5] * 8, 1), (1040, [0.5] * 8, None)]
    rows += [(1050, [0.5] * 4, 1), (1051, [0.25] * 4, 1), (1052, [0.2] * 4, 2), (1060, [], 1), (1061, [], 1), (1062, [], 2), (1070, [0.1] * 3, 5), (20, [9.0] * 8, 1), (30, rows[30][1], rows[30][2]), (30, rows[30][1], 3)]
    assert check(spark, rows, **kw)


def test_windows_without_rows(spark):
    """Negative positives have no window, a positive of nothing only nothing."""
    assert check(spark, [(10, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [-0.5, 0.0], 2), (13, [0.5, 0.0], 2)]) == []
    assert check(spark, [(10, [1.0, 0.0], 1), (11, [0.0, 1.0], 1), (12, [0.0, -0.5], 2), (13, [0.5, 0.0], 2)]) == [(10, 11, 1, 12, 0, 0)]
    assert check(spark, [(10, [1.0], 1)]) == [] == check(spark, [])


@pytest.mark.parametrize("kw", [{}, {"bucket_rows": 8, "block_rows": 5, "cell_bytes": 2000}])
def test_large_components(spark, kw):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.3, 1) * rng.choice([1, 1e4, 7e4, 1e9, 1e20, 1e37]) for _ in range(6)], rng.randrange(3)) for i in range(150)]
    rows += [(300 + i, [70000.0] * 6, i % 2) for i in range(20)] + [(400, [3e38] * 6, 1), (401, [3e38] * 6, 1), (402, [2e38] * 6, 2)]
    assert check(spark, rows, **kw)
    assert check(spark, [(i, [rng.uniform(0, 1) * rng.choice([1e5, 3e5]) for _ in range(4)], i % 3) for i in range(80)], **kw)


def test_components_at_the_end_of_doubles(spark):
    rng = random.Random(4)
    assert check(spark, [(i, [rng.uniform(0, 1) * rng.choice([1.0, 1e307, 1e308, 1e160]) for _ in range(4)], i % 3) for i in range(100)], kind="double", bucket_rows=16)


def test_repeated_rows(spark):
    assert check(spark, [(10, [0.5, 0.5], 1)] * 20 + [(11, [0.25, 0.5], 2)] * 30 + [(12, [0.5, 0.25], 1)] * 3, bucket_rows=4)


def test_short_buckets_are_left_out(spark, monkeypatch):
    """No bucket is scored whose bound is below all limits."""
    import numpy as np
    import pyarrow as pa

    scored = []
    monkeypatch.setattr(H, "_scores", lambda a, b, f=H._scores: scored.append(len(b)) or f(a, b))
    x = np.array([[1.0 - i / 1000, 0.0] for i in range(1000)])
    slices = []
    for i in range(0, 1000, 50):
        own = H.whole_numbers(x[i : i + 50], 256)
        data, kind = H._packed(own)
        slices.append({"top": float(H._norms(own).max()), "ids": np.arange(i, i + 50).astype("<i8").tobytes(), "labels": np.zeros(50, "<i8").tobytes(), "keys": np.arange(i, i + 50).astype("<i8").tobytes(), "data": data, "kind": kind})
    anchors = pa.table({"dim": [2], "anchor": [5000], "label": [0], "x": [[1.0, 0.0]], "low": [["0"]], "high": [[str(1 << 62)]]})
    found = H.searched(anchors, pa.Table.from_pylist(slices), 256, 5, True, False)
    assert found.column("vec_id").to_pylist() == [0, 1, 2, 3, 4] and len(scored) <= 2


def test_labels_move(spark):
    df = spark.createDataFrame([(14, [1.0], 9, 0), (15, [1.0], 9, 0), (7, [1.0], None, 0)], "vec_id long, embedding array<float>, label int, x int")
    assert sorted((r.vec_id, r.label) for r in H.labelled(df, every=7).where("label IS NOT NULL").collect()) == [(14, 0), (15, 9)]
