import hashlib

import pytest
from pyspark.errors import PySparkException

from chatloom.llm import warc_archive as A

BIG = "é<p>" * 300
ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (7, "http://c\r\nX-Refers-To-Page: 9", BIG), (7, "http://c", BIG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", BIG), (None, "n", "z" * 2000), (None, "n", "z" * 2000), (8, "", "y" * 1000), (9, "", "y" * 1000), (10, "", "y" * 999), (11, "", "y" * 999)]


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x") for p, u, h in rows], "page_id long, url string, html string, digest string")


def want(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(ids, default=None)
        again = len(data) >= 1000 and last is not None and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_records_come_back(spark):
    got = A.archived(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want(ROWS)


def test_a_payload_of_many_pages_is_rebuilt_once(spark, monkeypatch):
    monkeypatch.setattr(A, "HOT", 4)
    rows = ROWS + [(100 + i, "u", None if i % 2 else "") for i in range(60)] + [(300 + i, "v", "same short text") for i in range(30)] + [(400 + i, "w", BIG) for i in range(9)]
    joined = []
    monkeypatch.setattr(A, "_rebuilt", lambda headers, payloads, f=A._rebuilt: joined.append(headers) or f(headers, payloads))
    got = A.archived(pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want(rows)
    assert max(r["count"] for h in joined for r in h.groupBy("digest").count().collect()) <= 4


def test_exact_round_trip_and_one_copy(spark, tmp_path):
    A.write_archive(pages(spark, ROWS), f"{tmp_path}/a")
    assert A.read_payloads(spark, f"{tmp_path}/a").count() == len({h or "" for _, _, h in ROWS})
    records = A.read_records(spark, f"{tmp_path}/a").collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in records if r.page_id) == sorted((p, h or "") for p, _, h in ROWS if p)
    for r in records:
        header, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:])
        assert header.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields["Content-Length"]) + 4
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        assert rest[:-4] == (b"" if r.record_type == "revisit" else bytes(r.payload))


def test_changed_payload_is_found(spark, tmp_path):
    A.write_archive(pages(spark, ROWS), f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("digest", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(stored).write.mode("overwrite").parquet(f"{tmp_path}/a/payloads")
    with pytest.raises(PySparkException, match="does not have the digest"):
        A.read_payloads(spark, f"{tmp_path}/a").collect()


def test_changed_header_is_found(spark, tmp_path):
    A.write_archive(pages(spark, ROWS), f"{tmp_path}/a")
    records = spark.read.parquet(f"{tmp_path}/a/records")
    rows = records.selectExpr("page_id", "regexp_replace(header, 'Content-Length: 5', 'Content-Length: 6') AS header", "digest").collect()
    spark.createDataFrame(rows, records.schema).write.mode("overwrite").parquet(f"{tmp_path}/a/records")
    with pytest.raises(PySparkException, match="header and payload disagree"):
        A.read_records(spark, f"{tmp_path}/a").collect()


def test_payloads_are_not_shuffled_again(spark, tmp_path):
    stored = A.write_archive(pages(spark, ROWS), f"{tmp_path}/a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.read_records(spark, f"{tmp_path}/a", stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_rows(spark):
    assert A.archived(pages(spark, [])).collect() == []
