import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from chatloom.operators.archive import Archive
from chatloom.sources import history

ITEM = "struct<id string, content string>"


def segment(folder, name, kind, *ops):
    raw = gzip.compress("\n".join([json.dumps({"schema": "s", "kind": kind}), *map(json.dumps, ops)]).encode())
    (folder / name).write_bytes(raw)
    return name, hashlib.sha256(raw).hexdigest()


def up(i, text):
    return {"op": "upsert", "item": {"id": i, "content": text}}


def test_segments(spark, tmp_path):
    sums = [segment(tmp_path, "0000000001-a.jsonl.gz", "delta", up("9", "gone with the snapshot")), segment(tmp_path, "0000000002-a.jsonl.gz", "snapshot", up("1", "a"), up("2", "b")), segment(tmp_path, "0000000003-a.jsonl.gz", "delta", up("1", "c"), {"op": "delete", "id": "2"}, up("3", None))]
    ops = history.segment_operations(spark, str(tmp_path), ITEM, spark.createDataFrame(sums, "file string, sha256 string"))
    assert sorted((r.id, r.item.content) for r in history.state_of(ops).collect()) == [("1", "c"), ("3", None)]
    with pytest.raises(PySparkException, match="checksum"):  # one that the list lacks
        history.segment_operations(spark, str(tmp_path), ITEM, spark.createDataFrame(sums[1:], "file string, sha256 string")).collect()
    wrong = spark.createDataFrame([(sums[0][0], "0" * 64)], "file string, sha256 string")
    with pytest.raises(PySparkException, match="checksum"):
        history.segment_operations(spark, str(tmp_path), ITEM, wrong).collect()


@pytest.mark.parametrize("kind,ops,match", [("delta", [{"what": 1}], "no operation"), ("other", [up("1", "x")], "no header")])
def test_broken_segments(spark, tmp_path, kind, ops, match):
    segment(tmp_path, "0000000001-a.jsonl.gz", kind, *ops)
    with pytest.raises(PySparkException, match=match):
        history.segment_operations(spark, str(tmp_path), ITEM).collect()


def test_single_file_archives(spark, tmp_path):
    rows = [{"id": "1", "content": "a\nb"}, {"id": "2", "content": None}]
    (tmp_path / "plain.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(json.dumps({"items": rows}).encode()))
    for name in ("plain.json", "packed.json.gz"):
        assert sorted(map(tuple, history.legacy_rows(spark, str(tmp_path / name), ITEM).collect())) == [("1", "a\nb"), ("2", None)]
    archive = Archive(spark, str(tmp_path / "archive"))
    assert archive.migrate(history.legacy_rows(spark, str(tmp_path / "plain.json"), ITEM)) == 1 and archive.snapshot().count() == 2


def test_logs_replayed(spark, tmp_path):
    schema = "started_at string, conversation_id string, conversation_name string, records array<struct<id string, content string>>"
    logs = spark.createDataFrame([("2024-01-02", "c", "C", [("1", "new"), ("2", "b")]), ("2024-01-01", "c", "C", [("1", "old"), ("3", None)]), ("2024-01-03", "c", "C", [])], schema)
    rows = history.replayed(logs)
    assert sorted((r.id, r.content, r.ai_analyzed_at) for r in rows.collect()) == [("1", "new", "2024-01-02"), ("2", "b", "2024-01-02"), ("3", None, "2024-01-01")]
    archive = Archive(spark, str(tmp_path / "a"))
    assert history.recovered(archive, rows) and archive.snapshot().count() == 3
    assert not history.recovered(archive, rows.limit(1)) and archive.snapshot().count() == 3


def test_folders_scanned(spark, tmp_path):
    for name in ("a.json", "b.CSV", "c.png", "d/e.txt", "d/f/g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (100 if name == "b.CSV" else 3))
    files = history.files_below(spark, str(tmp_path))
    taken, told = history.scanned(files, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in taken.collect()) == ["a.json", "b.CSV", "e.txt", "g.txt"] and told.first().complete
    taken, told = history.scanned(files, str(tmp_path), most_files=1, most_bytes=50, most_depth=1)
    assert taken.count() == 1 and told.first().asDict() == {"complete": False, "truncated": True, "oversized": 1, "too_deep": True}


def test_operations_of_one_segment_keep_their_order(spark, tmp_path):
    segment(tmp_path, "0000000001-a.jsonl.gz", "delta", *[up("1", f"v{i:04}") for i in range(3000)], {"op": "delete", "id": "2"}, up("2", "again"), up("3", "x"), {"op": "delete", "id": "3"})
    ops = history.segment_operations(spark, str(tmp_path), ITEM).repartition(7)
    assert sorted((r.id, r.item.content) for r in history.state_of(ops).collect()) == [("1", "v2999"), ("2", "again")]
