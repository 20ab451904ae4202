import json

from chatloom.sources import files as S


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_json_takes_what_is_around(spark, tmp_path):
    document = {"nickname": "Ann", "face": "https://a/x.png", "messages": [{"time": 1704067200, "type": "sent", "content": "hello there"}, {"formattedTime": "2024-01-02 10:00:00", "isSelf": False, "body": " two  words "}, {"content": "x"}, {"sender": {"profile": {"displayName": "Bo"}}, "text": "nested name", "selfUin": "7", "fromUin": "7"}]}
    put(tmp_path, "direct/Ann/a.json", json.dumps(document))
    rows = [r.asDict() for r in S.read_json(spark, str(tmp_path)).orderBy("ord").collect()]
    assert [(r["text"], r["at"], r["speaker"], r["speaker_role"], r["avatar_url"]) for r in rows] == [
        ("hello there", "1704067200", "Ann", "self", "https://a/x.png"),
        ("two words", "2024-01-02 10:00:00", "Ann", "other", "https://a/x.png"),
        ("nested name", None, "Bo", "self", "https://a/x.png"),
    ]
    got = S.messages(S.read_json(spark, str(tmp_path)), str(tmp_path)).orderBy("captured_at").collect()
    assert {(r.conversation_id, r.conversation_name, r.conversation_kind) for r in got} == {("folder:direct/Ann", "Ann", "direct")}
    assert {r.captured_at for r in got} == {None, "2024-01-01T00:00:00", "2024-01-02T10:00:00"}


def test_json_without_messages_and_broken_json(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps({"settings": {"colour": "dark blue", "n": 1}}))
    put(tmp_path, "b.json", "{not json")
    assert [r.text for r in S.read_json(spark, str(tmp_path)).collect()] == ["settings: colour: dark blue", "settings: n: 1"]
    assert S.read_json(spark, str(tmp_path), strict=True).count() == 0


def test_csv(spark, tmp_path):
    put(tmp_path, "a.csv", 'time,sender,Content,is_send\n2024-01-02 10:00,Bo,"a, ""quoted""\nline",1\n\n2024-01-03,Bo,x,0\n2024-01-04,Bo,yes,0\n')
    put(tmp_path, "b.csv", "one,two\nplain line,3\n")
    rows = {(r.text, r.at, r.speaker_role) for r in S.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {('a, "quoted" line', "2024-01-02 10:00", "self"), ("yes", "2024-01-04", "other"), ("one,two", None, "unknown"), ("plain line,3", None, "unknown")}


def test_text_lines_carry_times_forward(spark, tmp_path):
    put(tmp_path, "a.txt", "first words\r\n[2024-01-02 10:00:00]\nAnn: not a name here\n2024年1月3日 7:05 Bo： hi there\n\nmore\n[2024-02-30] lost\nx\n")
    rows = [(r.text, r.at, r.speaker) for r in S.read_text(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == [("first words", None, None), ("Ann: not a name here", "2024-01-02T10:00:00", None), ("hi there", "2024-01-03T07:05:00", "Bo"), ("more", "2024-01-03T07:05:00", None), ("lost", "2024-01-03T07:05:00", None)]


def test_conversations_from_paths(spark):
    paths = {
        "群聊/Team/data/a.json": ("folder:群聊/Team", "Team", "group"),
        "direct/AI/Helper/Trip/messages.json": ("folder:direct/AI/Helper/Trip", "Trip", "direct"),
        "exports/私聊_Alice.json": ("folder:exports/私聊_Alice", "私聊_Alice", "direct"),
        "direct/Bob.json": ("folder:direct/Bob", "Bob", "direct"),
        "some/where/a.json": ("folder:some/where", "where", "unknown"),
        "alone.json": ("folder:alone", "alone", "unknown"),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", S.conversation_of("path").alias("c"), S.source_of("path").alias("s"))
    assert {r.path: tuple(r.c) for r in df.collect()} == paths
    assert {r.s for r in df.collect()} == {"本地文件"}


def test_manifests(spark, tmp_path):
    put(tmp_path, "a.txt", "one")
    put(tmp_path, "b.txt", "two")
    old = spark.createDataFrame(S.manifest(spark, str(tmp_path)).collect())
    put(tmp_path, "a.txt", "longer")
    (tmp_path / "b.txt").unlink()
    put(tmp_path, "c.txt", "new")
    got = {r.path.rsplit("/", 1)[1]: r.change for r in S.planned(old, S.manifest(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "changed", "b.txt": "removed", "c.txt": "added"}
