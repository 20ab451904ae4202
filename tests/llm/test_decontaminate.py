import random
import re

import pytest

from chatloom.llm import decontaminate as C


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items, window):
    out = []
    split = [(i, words(t)) for i, t in items]
    for d, t in rows:
        w, hit, met = words(t), set(), set()
        for i, x in split:
            if i is None or not x:
                continue
            n = min(window, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    met.add(str(i))
        out.append((d, len(w), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(seed=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["Été", "ß", "7"]
    items = [(f"i{k}", " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for k in range(30)]
    items += [("i0", items[0][1]), (None, "w1 w2 w3"), ("null", None), ("p", "!!!")]
    rows = []
    for i in range(80):
        text = [rng.choice(vocab) for _ in range(rng.choice([0, 2, 30, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(items)[1] or ""
            cut = passage.split(" ")
            a = rng.randint(0, len(cut))
            text[rng.randint(0, len(text)) : 0] = cut[a : a + rng.randint(1, 40)] if rng.random() < 0.5 else cut
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 5 == 0 else " ".join(text)))
    return rows + [(100, None), (101, ""), (102, " -- "), (103, rows[2][1]), (103, rows[2][1]), (None, rows[3][1]), (104, "w1 " * 20000), (105, "x" * 50000)], items


@pytest.mark.parametrize("window,k", [(13, 5), (4, 2), (1, 1)])
def test_against_brute_force(spark, window, k):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id long, text string, item_id string, n_words int").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = C.judged(C.benchmark_hits(docs, bench, window, k)).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items, window)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert sorted(tuple(r) for r in C.benchmark_hits(docs, none).select("doc_id", "n_words", "n_hit").collect()) == [(1, 2, 0), (2, 0, 0)]
    assert C.benchmark_hits(docs.limit(0), none).collect() == []


def test_a_line_of_many_items_in_many_documents(spark):
    """4,000 documents and 4,000 items share a window: one row a document and not 16 million."""
    line = " ".join(f"w{i}" for i in range(13))
    docs = spark.range(4000).selectExpr("id AS doc_id", f"concat('start ', '{line}', ' end ', id) AS text")
    bench = spark.range(4000).selectExpr("concat('i', id) AS item_id", f"concat('{line}', ' of ', id) AS text")
    hits = C.benchmark_hits(docs, bench, told=lambda items: {"n_items": C.F.size(items)})
    assert hits.groupBy("n_words", "n_hit", "n_items").count().collect() == [(16, 13, 4000, 4000)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
