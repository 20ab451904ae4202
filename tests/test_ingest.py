import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from chatloom.operators.archive import Archive
from chatloom.sources import inbox as I
from chatloom.sources import layouts
from chatloom.streaming import ingest

ENVELOPE = I.Envelope("delta/v1", "PRODUCER", "immutable", "row")


def record(i, **other):
    return {"id": f"row:acc:{i}", "content": f"text {i}", "capturedAt": "2024-01-02T10:00:00Z", "conversationId": "c1", "speaker": "Ann"} | other


def batch(records, deletes=(), **other):
    return json.dumps({"schema": "delta/v1", "generatedAt": "2024-01-02T10:00:00Z", "producer": {"name": "PRODUCER", "version": "1", "layout": "immutable"}, "account": {"id": "acc"}, "records": records, "deleteIds": list(deletes)} | other)


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def run(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    docs = ingest.document_stream(spark, str(tmp_path / "in"), files_each=1)
    ingest.chat_ingest(docs, archive, ENVELOPE, "chat", str(tmp_path / "bad"), str(tmp_path / "point")).awaitTermination(120)
    return archive


def test_documents_become_operations(spark):
    rows = [record(1), record(2, content=" "), record(3, capturedAt="no time"), record(1, content="later", conversationKind="group"), record(4, conversationId=None), "text", None]
    docs = spark.createDataFrame([("a", batch(rows, ["row:acc:1", "row:acc:9", "row:other:9", " "])), ("b", batch([], schema="delta/v2")), ("c", "{broken"), ("d", batch([record(5)], account={"id": ""}))], "source_file string, value string")
    ups, downs, bad = I.chat_operations(docs, ENVELOPE, "chat")
    got = ups.collect()
    assert [(r.id, r.content, r.conversation_kind, r.summary, r.captured_at) for r in got] == [("row:acc:1", "later", "group", "Ann: later", "2024-01-02T10:00:00.000Z")]
    assert [r.id for r in downs.collect()] == ["row:acc:9"] and sorted(r.source_file for r in bad.collect()) == ["b", "c", "d"]


def test_stream_is_idempotent_over_restarts(spark, tmp_path):
    put(tmp_path / "in", "1.json", batch([record(1), record(2)]))
    archive = run(spark, tmp_path)
    first = archive.version()
    assert {r.id for r in archive.snapshot().collect()} == {"row:acc:1", "row:acc:2"}
    run(spark, tmp_path)
    put(tmp_path / "in", "2.json", batch([record(1), record(2)]))  # the same rows in a new envelope
    put(tmp_path / "in", "3.json", "{half a docu")
    run(spark, tmp_path)
    assert archive.version() == first
    put(tmp_path / "in", "4.json", batch([record(2, content="changed")], ["row:acc:1"]))
    run(spark, tmp_path)
    assert [(r.id, r.content) for r in archive.snapshot().collect()] == [("row:acc:2", "changed")]
    assert {(r.id, r.op) for r in archive.changes(first).collect()} == {("row:acc:1", "delete"), ("row:acc:2", "upsert")}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_coordinates_need_consent(spark):
    where = {"latitude": 1.5, "longitude": 2.5, "accuracyMeters": 5e7}
    consent = {"exactLocation": True, "captureMode": "manual", "grantedAt": "2024-01-01T00:00:00Z"}
    base = {"source": "device", "kind": "location", "startAt": "2024-01-02T10:00:00Z", "location": where, "privacy": "precise"}
    events = [base | {"id": "a", "locationConsent": consent}, base | {"id": "b"}, base | {"id": "c", "locationConsent": consent, "privacy": "coarse"}, base | {"id": "d", "locationConsent": consent, "kind": "odd"}, base | {"id": "e", "locationConsent": consent | {"captureMode": "x"}}, base | {"id": "f", "startAt": "?"}, base | {"id": "g", "endAt": "2024-01-01T00:00:00Z", "values": {"ok_1": "v", "1bad": "x", "empty": " "}}, base | {"source": "other"}, {k: v for k, v in base.items() if k != "id"}]
    doc = json.dumps({"schema": "delta/v1", "producer": {"name": "PRODUCER", "version": "1", "layout": "immutable"}, "device": {"platform": "android"}, "events": events})
    docs = spark.createDataFrame([("x", doc), ("y", doc.replace("android", "toaster"))], "source_file string, value string")
    rows, bad = I.device_events(docs, ENVELOPE, "device", "2024-02-01T00:00:00.000Z")
    got = {r.id: r for r in rows.collect()}
    assert [r.source_file for r in bad.collect()] == ["y"] and "f" not in got and len(got) == 7
    assert [k for k, r in got.items() if r.location is not None] == ["a"] and got["a"].location.accuracy_m == 1e6 and got["a"].privacy == "precise"
    assert got["d"].kind == "custom" and got["g"].end_at is None and got["g"]["values"] == {"ok_1": "v"}
    assert all(len(k) == 28 and k.startswith("context-") for k in got if len(k) > 1)


def test_event_windows(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:05:00"), (1, "a", "2024-01-01 00:25:00"), (1, "a", "2024-01-01 05:00:00")], "user_id long, kind string, at string").select("user_id", "kind", F.to_timestamp("at").alias("start_ts")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("user_id long, kind string, start_ts timestamp").parquet(str(tmp_path / "ev"))
    ingest.activity_windows(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.events, str(r.start)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "2024-01-01 00:00:00")]


def test_net_operations_are_the_latest(spark):
    """In one pass over the entries, what chat_operations and latest_of give in several."""
    rng = random.Random(3)
    texts = [batch([record(rng.randrange(9), content=f"{d}-{n}", title=rng.choice([None, "t"])) for n in range(rng.randrange(8))], {f"row:acc:{rng.randrange(9)}" for _ in range(5)}) for d in range(12)]
    docs = spark.createDataFrame([(f"f{rng.randrange(100):02}-{d}", t) for d, t in enumerate(texts)] + [("x", "{broken")], "source_file string, value string")
    for some in (docs, docs.where("source_file < 'f5'"), docs.where("source_file = 'x'")):
        upserts, deletes, _ = I.chat_operations(some, ENVELOPE, "chat")
        ups, downs = I.latest_of(upserts, deletes)
        net, bad = I.chat_net(some, ENVELOPE, "chat")
        got = net.where("up = 1").select("id", "row.*")
        assert got.columns == ups.columns and sorted(map(str, got.collect())) == sorted(map(str, ups.collect()))
        assert {r.id for r in net.where("up = 0").collect()} == {r.id for r in downs.collect()}
        assert [r.source_file for r in bad.collect()] == [r.source_file for r in some.where("source_file = 'x'").collect()]
        assert net._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_documents_and_records_are_parsed_once(spark):
    """Neither the filter on envelopes nor that on records parses again what it filters."""
    docs = spark.createDataFrame([("a", batch([record(1)], ["row:acc:2"]))], "source_file string, value string")
    net, bad = I.chat_net(docs, ENVELOPE, "chat")
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") for df in (net, bad)] == [3, 1]


def test_documents_in_one_folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 13 AS of_what", "id")
    path = layouts.documents(rows, "of_what", F.struct(F.array_sort(F.collect_list("id")).alias("ids")), apart=False).removeprefix("file:")
    found = sorted(Path(path).glob("*.txt"))
    assert len(found) == 13 and not [p for p in Path(path).iterdir() if p.is_dir()]
    assert sorted(json.loads(p.read_text())["ids"] for p in found) == sorted([*range(i, 40, 13)] for i in range(13))
