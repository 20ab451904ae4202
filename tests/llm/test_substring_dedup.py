import random
import re

import pytest

from chatloom.llm import substring_dedup as S


def brute(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for p in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[p : p + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if d is not None and first[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß,"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 60, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text[rng.randint(0, len(text)) : 0] = p[a : a + rng.randint(5, 90)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows + [(-5, rows[7][1]), (100, None), (101, ""), (102, " "), (103, rows[3][1]), (103, rows[3][1]), (103, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (104, "same " * 20000), (105, "same " * 300), (106, "x" * 50000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, block string, start int").repartition(4)


@pytest.mark.parametrize("window,gram,threshold", [(50, 16, None), (12, 4, None), (12, 4, "-1")])
def test_against_brute_force(spark, monkeypatch, window, gram, threshold):
    rows = corpus()
    if threshold:  # many blocks, joined by a shuffle
        monkeypatch.setattr(S, "blocks_for", lambda *_: 7)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = S.remove_repeated_passages(frame(spark, rows), window, gram).select("doc_id", "n_words", "n_removed", "text").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


@pytest.mark.parametrize("blocks_log2", [0, 4])
def test_estimates_lose_no_repeated_window(spark, blocks_log2):
    """Every window that two documents have lies in a run whose anchor is estimated repeated."""
    window, gram = 12, 4
    rows = [(d, t) for d, t in dict(corpus(7)).items() if d is not None]
    docs = S.with_row_key(frame(spark, rows))
    runs = S.segments(docs, window, gram, blocks_log2)
    kept = S.estimated_repeated(runs, S.sketch(docs, window, gram, blocks_log2)).collect()
    have = {(r.doc_id, p) for r in kept for p in range(r.start, r.start + r.n)}
    holders, places = {}, []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for p in range(len(w) - window + 1):
            places.append((d, p, tuple(w[p : p + window])))
            holders.setdefault(places[-1][2], set()).add(d)
    assert {(d, p) for d, p, g in places if len(holders[g]) > 1} <= have
    assert len(kept) < runs.count()


def test_many_equal_rows(spark):
    """Rows that repeat an id and its text cost a row each, not a pair each."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(100_000).selectExpr("7L AS doc_id", f"'{passage} own' AS text").unionAll(spark.createDataFrame([(1, passage + " other"), (9, passage + " more")], "doc_id long, text string"))
    got = S.remove_repeated_passages(docs).groupBy("doc_id", "n_words", "n_removed", "text").count().collect()
    assert sorted(map(tuple, got)) == [(1, 61, 0, passage + " other", 1), (7, 61, 60, "own", 100_000), (9, 61, 60, "more", 1)]


def test_no_rows(spark):
    assert S.remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
