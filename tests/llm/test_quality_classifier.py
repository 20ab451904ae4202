import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import quality_classifier as Q


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 8))) for _ in range(rng.choice([20, 80, 300]))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w + "###" for w in words], [w.upper() + "!!" for w in words], [words[0]] * len(words), [w + " |" for w in words]])
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12))))
        labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(d, t, "s", 0.5) for d, t in rows], "doc_id long, text string, source string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (5002, " \n"), (None, "x"), (5003, "word " * 60000), (5004, rows[3][1]), (5004, rows[3][1])]
    docs, known = frames(spark, rows + extra, labels + [(None, 1), (7, None), (8, 5)])
    got = Q.scored(docs, Q.fit(docs, known)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(200)
    docs, known = frames(spark, rows, labels)
    other = known.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in Q.scored(docs, Q.fit(docs, x)).collect()} for x in (known, other))
    assert a == pytest.approx(b, abs=1e-9)


def test_no_labels_and_no_rows(spark):
    docs, none = frames(spark, [(1, "a"), (2, None)], [])
    assert {r.score for r in Q.scored(docs, Q.fit(docs, none)).collect()} == {0.5}
    assert Q.scored(docs.limit(0), Q.fit(docs.limit(0), none)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=30))
def test_pooling_rises(bins):
    good = np.array([float(min(a, b)) for a, b in bins])
    total = np.array([float(max(a, b, 1)) for a, b in bins])
    at, share = Q.pooled(np.arange(len(bins), dtype=float), good, total)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all() and 0 <= share.min() and share.max() <= 1
