import random
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.llm import lm_scoring as L


def brute(rows, good, folds, size, word_weight=100.0, pair_weight=50.0):
    """rows: (doc_id, text); folds: of each text."""
    split = [[w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for _, t in rows]
    counts = Counter(w for ws in split for w in ws)
    known = set(sorted(counts, key=lambda w: -counts[w])[:size])
    assert len(counts) <= size or sorted(counts.values(), reverse=True)[size - 1] > sorted(counts.values(), reverse=True)[size], "a tie would hang on hashes"
    split = [[w if w in known else None for w in ws] for ws in split]
    n_known = len(known)
    pairs = [list(zip(["<s>", *ws], ws, strict=False)) for ws in split]
    tables = {}
    for fold in range(2):
        every, target = Counter(), Counter()
        for (d, _), f, p in zip(rows, folds, pairs, strict=True):
            if f != fold:
                every.update(p)
                if d in good:
                    target.update(p)
        tables[fold] = (target, every)

    def model(table, scale):
        each, before, total = Counter(), Counter(), sum(table.values()) * scale
        for (v, w), n in table.items():
            each[w] += n * scale
            before[v] += n * scale
        return lambda v, w: -log((table[v, w] * scale + pair_weight * (each[w] + word_weight / (n_known + 1)) / (total + word_weight)) / (before[v] + pair_weight))

    out = []
    for (d, _), f, p in zip(rows, folds, pairs, strict=True):
        target, every = tables[f]
        a, b = sum(target.values()), sum(every.values())
        background = model(every, a / b if a else 1)
        lt, lb = (sum(m(*x) for x in p) / len(p) if p else None for m in (model(target, 1) if a else background, background))
        out.append((d, len(p), lt, lb, lt - lb if p else None))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"Word{i}" for i in range(30)] + ["ÉTÉ", "x,", "-"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 60, 200])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n\t"), (103, rows[4][1]), (103, rows[4][1]), (None, rows[9][1]), (105, "only " * 5000), (106, "z" * 30000)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "clash", 0.5) for d, t in rows], "doc_id long, text string, label_id string, target double").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def key(r):
    return (str(r[0]), r[1], str(r[2])[:8])


@pytest.mark.parametrize("broadcast_ids", [1 << 20, 0])
def test_against_brute_force(spark, broadcast_ids):
    rows = corpus()
    labels = [(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (7, None), (1, 1)]
    docs, known = frames(spark, rows, labels)
    folds = dict(docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2))).collect())
    good = {d for d, q in labels if q == 1 and d is not None and zlib.crc32(str(d).encode()) % 5}
    got = sorted(map(tuple, L.cross_entropy_difference(docs, known, vocabulary=12, broadcast_ids=broadcast_ids).collect()), key=key)
    expect = sorted(brute(rows, good, [folds[t] for _, t in rows], 12), key=key)
    assert len(got) == len(expect)
    for a, b in zip(got, expect, strict=True):
        assert a[:2] == b[:2]
        assert a[2:] == (None, None, None) if b[2] is None else a[2:] == pytest.approx(b[2:], abs=2e-4)


def test_without_labels_and_without_rows(spark):
    docs, none = frames(spark, corpus(), [])
    assert {r.score for r in L.cross_entropy_difference(docs, none, vocabulary=12).collect()} == {0.0, None}
    assert L.cross_entropy_difference(docs.limit(0), none).collect() == []


def test_scores_tell_the_target_apart(spark):
    rng = random.Random(8)
    one, two = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(one if i % 2 else two, k=80))) for i in range(200)]
    docs, known = frames(spark, rows, [(i, i % 2) for i in range(0, 100)])
    got = L.cross_entropy_difference(docs, known, vocabulary=64).collect()
    late = [r for r in got if r.doc_id >= 100]
    assert max(r.score for r in late if r.doc_id % 2) < min(r.score for r in late if not r.doc_id % 2)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=30), max_size=8), st.integers(1, 40))
def test_tally(parts, limit):
    tally, total = L.Tally(limit), Counter()
    for p in parts:
        tally.add(np.array(p, np.int64))
        if tally.full():
            total.update(dict(zip(*(x.to_pylist() for x in tally.take().columns), strict=True)))
    for k, n in zip(*(x.to_pylist() for x in tally.take().columns), strict=True):
        total[k] += n
    assert total == Counter(x for p in parts for x in p)


def test_every_word_counts(spark):
    """More words than any fixed vocabulary, over several groups: against brute force, and rare words tell texts apart."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(120))) for i in range(120)] + [(120 + i, "common " * 40 + f"rare{i % 3} rare{i % 2}") for i in range(60)]
    labels = [(i, int(i % 3 > 0)) for i in range(180)]
    docs, known = frames(spark, rows, labels)
    folds = dict(docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2))).collect())
    good = {d for d, q in labels if q == 1 and zlib.crc32(str(d).encode()) % 5}
    got = sorted(map(tuple, L.cross_entropy_difference(docs, known, group_bytes=5000).collect()), key=key)
    expect = sorted(brute(rows, good, [folds[t] for _, t in rows], 1 << 20), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in expect]
    for a, b in zip(got, expect, strict=True):
        assert a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_the_query_has_no_fixed_vocabulary(spark, tmp_path):
    from chatloom.llm.queries import op9_lm_scoring

    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(120))) for i in range(120)]
    labels = [(i, i % 2) for i in range(120)]
    docs, known = frames(spark, rows, labels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    folds = dict(docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2))).collect())
    good = {d for d, q in labels if q == 1 and zlib.crc32(str(d).encode()) % 5}
    got = sorted(map(tuple, op9_lm_scoring(spark, str(tmp_path)).collect()), key=key)
    expect = sorted(brute(rows, good, [folds[t] for _, t in rows], 1 << 20), key=key)
    for a, b in zip(got, expect, strict=True):
        assert a[2:] == pytest.approx(b[2:], abs=1e-9)
