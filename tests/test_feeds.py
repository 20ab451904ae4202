import json
import os
import time

import pytest

from chatloom.operators.archive import Archive
from chatloom.sources import inbox as I
from chatloom.streaming import feeds

ENVELOPE = I.Envelope("snap/v1", "PRODUCER", "immutable")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, text string")


def state(archive):
    return sorted((r.id, r.text) for r in archive.snapshot().collect())


@pytest.fixture
def pair(spark, tmp_path):
    spark.dataSource.register(feeds.ArchiveChanges)
    source, target = Archive(spark, str(tmp_path / "a")), Archive(spark, str(tmp_path / "b"))

    def run():
        stream = spark.readStream.format("archive_changes").option("path", source.path).load()
        feeds.follow(stream, target, str(tmp_path / "point")).awaitTermination(120)
        assert state(target) == state(source)

    return source, target, run


def test_a_target_follows_over_restarts_boundaries_and_gaps(spark, pair):
    source, target, run = pair
    none = spark.createDataFrame([], "id string")
    source.commit(rows(spark, ("1", "x"), ("2", None)))
    run()
    first = target.version()
    run()  # nothing new, nothing written
    assert target.version() == first
    source.commit_delta(rows(spark, ("3", "z")), none)
    source.commit_delta(rows(spark, ("3", "zz")), spark.createDataFrame([("1",)], "id string"))
    run()  # two versions in one batch
    assert target.version() == first + 1 and {(r.id, r.op) for r in target.changes(first).collect()} == {("1", "delete"), ("3", "upsert")}
    source.commit_delta(rows(spark, ("4", "before")), none)
    source.compact()  # the version that was read is gone, and so is one that was not
    source.commit_delta(rows(spark, ("5", "after")), spark.createDataFrame([("2",)], "id string"))
    run()
    source.commit(rows(spark, ("9", "only")))
    source.compact()
    source.commit_delta(rows(spark).limit(0), spark.createDataFrame([("9",)], "id string"))
    source.compact()  # an empty snapshot
    run()
    assert state(target) == []


def test_a_batch_that_runs_again_changes_nothing(spark, pair):
    source, target, run = pair
    source.commit(rows(spark, ("1", "x"), ("2", "y")))
    run()
    before = target.version()
    batch = spark.createDataFrame([(None, None, "reset", 1, True), ("1", "x", "upsert", 1, True), ("2", "y", "upsert", 1, True)], "id string, text string, op string, version long, reset boolean")
    assert feeds.applied(batch, target) == before
    delta = spark.createDataFrame([("2", None, "delete", 2, False), ("2", "new", "upsert", 3, False)], "id string, text string, op string, version long, reset boolean")
    assert feeds.applied(delta, target) == feeds.applied(delta, target) == before + 1
    assert state(target) == [("1", "x"), ("2", "new")]


def test_a_batch_planned_after_compaction_starts_over(spark, tmp_path):
    source = Archive(spark, str(tmp_path / "a"))
    for i in range(3):
        source.commit_delta(rows(spark, (str(i), "x")), spark.createDataFrame([], "id string"))
    schema = feeds.ArchiveChanges({"path": source.path}).schema()
    reader = feeds.ArchiveReader(source.path, schema)
    assert {(p.version, p.reset) for p in reader.partitions({"version": 1}, {"version": 3}) if p.file} == {(2, False), (3, False)}
    source.compact()
    parts = reader.partitions({"version": 1}, {"version": 3})
    assert parts[0].file is None and all(p.reset for p in parts)
    assert sorted(r["id"] for p in parts[1:] for b in reader.read(p) for r in b.to_pylist()) == ["0", "1", "2"]
    assert reader.partitions({"version": 4}, {"version": 4}) == []


def snapshot(*events, **other):
    return json.dumps({"schema": "snap/v1", "producer": {"name": "PRODUCER", "version": "1", "layout": "immutable"}, "device": {"platform": "android"}, "events": list(events)} | other)


def event(i, **other):
    return {"id": f"e{i}", "source": "device", "kind": "activity", "startAt": "2024-01-02T10:00:00Z", "title": f"t{i}"} | other


def put(root, folder, text, age=60):
    place = root / folder
    place.mkdir(parents=True, exist_ok=True)
    (place / "events.json").write_text(text)
    at = time.time() - age
    os.utime(place / "events.json", (at, at))


def test_snapshots_wait_settle_and_count(spark, tmp_path):
    spark.dataSource.register(feeds.SnapshotFiles)
    root, events, files = tmp_path / "in", Archive(spark, str(tmp_path / "events")), Archive(spark, str(tmp_path / "files"))
    log = tmp_path / "log"

    def run():
        stream = spark.readStream.format("snapshot_files").option("path", str(root)).option("folders", "SNAP-v1-.*").option("file", "events.json").option("mostBytes", 5000).load()
        query = feeds.device_ingest(stream, events, files, ENVELOPE, "device", "2024-02-01T00:00:00.000Z", str(log), str(tmp_path / "point"))
        if query is not None:
            query.awaitTermination(120)
        return query

    def counts():
        return {b.name: tuple(spark.read.parquet(str(b)).select("files", "invalid", "added", "updated", "duplicate").first()) for b in sorted(log.iterdir())} if log.exists() else {}

    def titles():
        return sorted((r.id, r.title) for r in events.snapshot().collect())

    put(root, "SNAP-v1-a", snapshot(event(1), event(2)))
    put(root, "other", snapshot(event(7)))
    put(root, "SNAP-v1-young", snapshot(event(8)), age=-30)
    put(root, "SNAP-v1-large", snapshot(event(9, title="x" * 9000)))
    assert run() is None and not counts()  # nothing is there yet that it could go into
    made, _ = I.device_events(spark.createDataFrame([("s", snapshot(event(0)))], "source_file string, value string"), ENVELOPE, "device", "2024-01-01T00:00:00.000Z")
    events.commit(made.drop("platform"))
    run()
    assert titles() == [("e0", "t0"), ("e1", "t1"), ("e2", "t2")] and list(counts().values()) == [(1, 0, 2, 0, 0)]
    assert feeds.listed(str(root), "SNAP-v1-.*", "events.json", 4000, 5000, 10)[1] == 2 and len(feeds.listed(str(root), "SNAP-v1-.*", "events.json", 4000, 5000, 1)[0]) == 1
    version = events.version()
    put(root, "SNAP-v1-a", snapshot(event(1), event(2)), age=50)  # the same text written again
    run()
    assert events.version() == version and list(counts().values())[1:] == [(0, 0, 0, 0, 0)]
    put(root, "SNAP-v1-a", snapshot(event(1), event(2, title="new")), age=40)
    put(root, "SNAP-v1-young", snapshot(event(8)))
    put(root, "SNAP-v1-odd", snapshot(event(5), schema="snap/v9"))
    put(root, "SNAP-v1-broken", "{half")
    run()
    assert titles() == [("e0", "t0"), ("e1", "t1"), ("e2", "new"), ("e8", "t8")] and list(counts().values())[2:] == [(3, 1, 1, 1, 1)]
    put(root, "SNAP-v1-broken", snapshot(event(6)), age=30)
    run()
    assert list(counts().values())[3:] == [(1, 0, 1, 0, 0)]
    assert {r.id: r.events for r in files.snapshot().collect()} == {"SNAP-v1-a/events.json": 2, "SNAP-v1-young/events.json": 1, "SNAP-v1-odd/events.json": 0, "SNAP-v1-broken/events.json": 1}
    known = events.version()
    os.rename(tmp_path / "point", tmp_path / "lost")  # a checkpoint that is lost costs reading, no changes
    run()
    assert events.version() == known


def test_entries_do_not_carry_their_document(spark):
    from chatloom.sources import inbox

    documents = spark.createDataFrame([("android/a", '{"schema":"x"}')], "source_file string, value string")
    envelope = inbox.Envelope("x", "p", "immutable", "m")
    made, _ = inbox.device_events(documents, envelope, "p", "2024-01-01T00:00:00.000Z")
    ups, downs, _ = inbox.chat_operations(documents, envelope, "p")
    for df in (made, ups, downs.sparkSession.createDataFrame([], "id string").join(downs, "id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Generate ")]
        assert "value#" not in above and "doc#" not in above  # else each row of a document is made from all of its text
