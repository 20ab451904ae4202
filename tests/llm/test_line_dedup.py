import hashlib
import random
import re
from collections import defaultdict

import pytest

from chatloom.llm import line_dedup as D

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least, chars):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    seen = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            seen[key(line)].add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(seen[key(x)]) >= least)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    common = [f"Line {i} é" for i in range(8)] + ["", " ", "X"]
    rows = []
    for i in range(80):
        lines = [rng.choice([rng.choice(common), rng.choice([" ", "\t"]) + rng.choice(common).upper() + " ", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (103, rows[3][1]), (None, rows[5][1]), (104, "Line 1 é\n" * 5000), (105, "y" * 40000), (106, "\r\nLine 1 é\r")]


@pytest.mark.parametrize("least,chars,batches,fanout", [(10, 1, 6, 3), (3, 4, 7, 2), (1, 0, 1, 3)])
def test_against_brute_force(spark, least, chars, batches, fanout):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, h1 string").repartition(4)
    got = D.drop_common_lines(docs, least, chars, batches, fanout).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least, chars)


def test_no_rows(spark):
    assert D.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = D.drop_common_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert hashlib.sha256(b"").hexdigest() == spark.sql("SELECT sha2('', 256)").first()[0]


def test_runs_are_merged_without_sorting(spark):
    """The scans of the runs are sorted, so merging them sorts nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = D.Runs(spark, 2, 3)
        for i in range(2):
            runs._place(runs._written(spark.range(1000).repartition(3).selectExpr("id AS h1", "id * 7 AS h2", "1L AS n").groupBy("h1", "h2").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")), 0)
        with D.in_bucket_order(spark):
            common = runs.common()
            plan = common._jdf.queryExecution().executedPlan().toString()
            assert common.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
