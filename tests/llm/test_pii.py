import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chatloom.llm import pii as P
from chatloom.llm.queries import op6_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts(seed=2):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "@", "..", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.000.1.09", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "4111  1111", "+1 (521) 555-2373", "+4", "+49 30 1", "+1+2", "+1234567890123456", "é", "😀", "\n", " ", "-", "7", "12", "and", "token = \"f0ddae3b09ae356cbefecdd3232fa5489bb400d6\"", "call (521) 555-2373 now", "write to joe (at) mail (dot) com", ".", "_", "%"]
    out = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return out + [None, "", " ", "1" * 30000, "1 " * 20000, "a." * 20000, "1.1.1.1 " * 3000, "x" * 60000, "a@" + "b." * 20000 + "c", "+1" + " 2" * 20000, "+" * 5000, out[3], out[3]]


def frame(spark, rows):
    return spark.createDataFrame([(i if i % 17 else None, t, "clash", [1]) for i, t in enumerate(rows)], "doc_id long, text string, base string, spans array<int>").repartition(3)


def test_base_spans_against_brute_force(spark):
    rows = texts()
    found = P.personal_data(frame(spark, rows)).select(P.joined(F.col("base")).alias("base"), P.joined(P.by_kind("base", "added")).alias("spans")).collect()
    assert sorted(r["base"] for r in found) == sorted(",".join(brute(t)) for t in rows)
    for r in found:
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
        order = [(("email", "ip", "card", "phone", "secret").index(k), int(a)) for k, a, _ in (x.split(":") for x in r["spans"].split(",") if x)]
        assert order == sorted(order)


def test_added_spans(spark):
    secret = "token = \"{}\""
    rng = random.Random(5)
    rows = [f"some words {secret.format(''.join(rng.choice('0123456789abcdef') for _ in range(40)))} here" for _ in range(60)]
    rows += ["a long" + "word" * 10 + " here"] * 30 + ["nothing"] * 5
    got = P.personal_data(frame(spark, rows)).select("added").collect()
    spans = [(x["kind"], x["start"], x["end"]) for r in got for x in r["added"]]
    assert spans == [("secret", 20, 60)] * 60


def test_no_rows_and_no_candidates(spark):
    assert P.personal_data(frame(spark, ["x"]).limit(0)).collect() == []
    assert [(r["base"], r["added"]) for r in P.personal_data(frame(spark, ["plain words", None])).collect()] == [([], []), ([], [])]


def test_reliabilities_find_the_odd_labeler():
    # two labelers agree, the third contradicts them at random
    rows = [("k", (1, 1, s), 50) for s in (-1, 1)] + [("k", (-1, -1, s), 50) for s in (-1, 1)] + [("k", (1, -1, 1), 2)]
    right = P.reliabilities(rows)
    assert min(right["k", (1, 1, s)] for s in (-1, 1)) > 0.9 > 0.1 > max(right["k", (-1, -1, s)] for s in (-1, 1))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 256, 257, 1000, 70000])
def test_running_sums(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 9) for _ in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(P._running("v").alias("r")).first()["r"]
    sums, total = [], 0
    for v in values:
        sums.append(total)
        total += v
    assert got == sums


def test_touching_spans(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 40):
        places = sorted(rng.sample(range(300), 2 * n))
        spans = list(zip(places[::2], places[1::2]))
        asked = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 300) for _ in range(100))]
        frame = spark.createDataFrame([(spans, asked)], "s array<struct<start:long,end:long>>, q array<struct<start:long,end:long>>")
        got = frame.select(F.transform("q", lambda x: P._touches(x, "s")).alias("r")).first()["r"]
        assert got == [any(a < e and b < f for a, f in spans) for b, e in asked]


def test_many_matches_take_little_time(spark):
    rows = ["12," * 16000, "1.2.3.4 " * 40000, "a@b.c " * 40000, "555 123 4567, " * 20000, "+49 301234567, 555 123 4567 " * 10000]
    began = time.time()
    found = P.personal_data(frame(spark, rows)).select(F.size("base").alias("n")).collect()
    assert sorted(r["n"] for r in found) == sorted([0, 40000, 40000, 0, 10000])
    assert time.time() - began < 120


def test_a_span_does_not_depend_on_other_text(spark):
    rows = ["WRITE TO JOE (AT) MAIL.COM NOW", "WRITE TO JOE (AT) MAIL.COM NOW at all", "write to joe [At] mail [DOT] com"]
    found = P.candidates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in found] == [[("email", 9, 26)], [("email", 9, 26)], [("email", 9, 32)]]


def test_account_numbers(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    bad = ["DE88 3704 0044 0532 0130 00", "XX89370400440532013000", "GB29NWBK6016133192681"]
    got = spark.createDataFrame([(x,) for x in good + bad], "m string").select((P._form("iban", F.col("m"), False) + P._listed("iban", F.col("m"), F.lit(""))).alias("v")).collect()
    assert [r["v"] for r in got] == [2, 2, 2, 0, -2, -2]
    rows = [f"my account is {good[i % 3]} for all" for i in range(40)] + [f"serial {bad[i % 3]} here" for i in range(40)]
    found = P.personal_data(frame(spark, rows)).select("added").collect()
    assert sum(x["kind"] == "iban" for r in found for x in r["added"]) == 40


def test_planted_secrets_and_addresses(spark):
    """Recall and precision of what is added, against the shape in which the tables hold secrets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts_of = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(d, m.start(1), m.end(1)) for d, t in texts_of.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    got = {(r["doc_id"], x["start"], x["end"]) for r in P.personal_data(docs).collect() for x in r["added"] if x["kind"] == "secret"}
    assert len(want & got) >= 0.95 * len(want) > 0 and len(want & got) >= 0.95 * len(got)


def test_query_columns(spark):
    got = op6_pii(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string"] * 2
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        expect = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in expect) for k in BASE]
