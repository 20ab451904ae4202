import pytest

from chatloom.operators.archive import Archive, Conflict, delta_or_snapshot, first_only


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, text string")


def state(archive):
    return sorted((r.id, r.text) for r in archive.snapshot().collect())


def test_commits_changes_and_compaction(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    assert a.version() == 0 and a.snapshot() is None and a.changes(0) is None
    one = a.commit(rows(spark, ("1", "x"), ("2", None)))
    assert a.commit(rows(spark, ("1", "x"), ("2", None))) == one  # nothing changes, nothing is written
    two = a.commit_delta(rows(spark, ("2", "y"), ("3", "z"), ("1", "x")), spark.createDataFrame([("1",), ("3",), ("9",)], "id string"))
    assert state(a) == [("1", "x"), ("2", "y"), ("3", "z")]  # an upsert beats a delete
    with pytest.raises(Conflict):
        a.commit_delta(rows(spark, ("8", "q")), spark.createDataFrame([], "id string"), expected=one)
    three = a.commit(rows(spark, ("3", "z")), expected=two)
    assert {(r.id, r.op) for r in a.changes(one).collect()} == {("1", "delete"), ("2", "delete"), ("3", "upsert")}
    assert a.changes(one, limit=1) is None and a.changes(99) is None and a.changes(three).count() == 0
    assert a.verify() == []
    four = a.compact()
    assert state(a) == [("3", "z")] and len(a.manifest()) == 1 and a.changes(one) is None
    spark.createDataFrame([("3", "other", "upsert")], "id string, text string, op string").write.mode("overwrite").parquet(f"{tmp_path}/a/{a.manifest()[-1]['folder']}")
    assert a.verify() == [four]


def test_a_writer_that_stops_changes_nothing(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "a"))
    one = a.commit(rows(spark, ("1", "x")))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Archive, "_publish", stop)
        for act in (lambda: a.commit(rows(spark, ("2", "y"))), a.compact):
            with pytest.raises(RuntimeError):
                act()
    again = Archive(spark, str(tmp_path / "a"))
    assert again.version() == one and state(again) == [("1", "x")] and again.verify() == []
    assert again.commit(rows(spark, ("2", "y"))) == one + 1 and state(again) == [("2", "y")]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    a, b = (Archive(spark, str(tmp_path / "a")) for _ in range(2))
    one = a.commit(rows(spark, ("1", "x")))
    stale = b.manifest()
    a.commit_delta(rows(spark, ("2", "a")), spark.createDataFrame([], "id string"))
    monkeypatch.setattr(b, "manifest", lambda: stale)  # b has looked before a published
    with pytest.raises(Conflict):
        b.commit_delta(rows(spark, ("3", "b")), spark.createDataFrame([], "id string"), expected=one)
    assert state(a) == [("1", "x"), ("2", "a")]


def test_many_changes_compact(spark, tmp_path, monkeypatch):
    from chatloom.operators import archive

    monkeypatch.setattr(archive, "COMPACT_LEAST", 3)
    a = Archive(spark, str(tmp_path / "a"))
    a.commit(rows(spark, *[(str(i), "x") for i in range(10)]))
    a.commit(rows(spark, ("1", "y")))  # ten operations over one row
    assert [s["kind"] for s in a.manifest()] == ["snapshot"] and state(a) == [("1", "y")]
    b = Archive(spark, str(tmp_path / "b"))
    assert b.migrate(rows(spark, ("1", "old"))) == 1 and b.migrate(rows(spark, ("2", "new"))) == 1 and state(b) == [("1", "old")]


def test_first_only(spark):
    df = spark.createDataFrame([(1, "c", "u"), (2, "c", "u"), (3, "d", "u"), (4, "c", None)], "id int, k string, url string")
    assert [(r.id, r.url) for r in first_only(df, "url", ["k"], ["id"]).orderBy("id").collect()] == [(1, "u"), (2, None), (3, "u"), (4, None)]


def test_delta_or_snapshot():
    assert [delta_or_snapshot(*x) for x in ((74, 100, True), (75, 100, True), (1, 100, False), (0, 100, True))] == ["delta", "snapshot", "snapshot", "nothing"]


def test_an_overtaken_window_reads_again(spark, tmp_path):
    def archive(name, fingerprint="dir-1", at="2024-01-01T00:00:00Z"):
        a = Archive(spark, str(tmp_path / name))
        assert a.saved(rows(spark, ("1", "x"), ("2", "y")), 0, fingerprint, at) == (1, "local")
        return a

    # the same source: both windows' rows, where both have one the later window's
    a = archive("same")
    assert a.saved(rows(spark, ("1", "one"), ("2", "y")), 1, "dir-1", "2024-01-01T00:00:00Z") == (2, "local")
    assert a.saved(rows(spark, ("1", "x"), ("2", "two"), ("3", "z")), 1, "dir-1", "2024-01-01T00:00:00Z") == (3, "both")
    assert state(a) == [("1", "x"), ("2", "two"), ("3", "z")]
    # another source: the newer snapshot stands whole
    b = archive("newer")
    assert b.saved(rows(spark, ("2", "y")), 1, "dir-2", "2024-01-03T00:00:00Z") == (2, "local")
    assert b.saved(rows(spark, ("7", "late")), 1, "dir-3", "2024-01-02T00:00:00Z") == (2, "remote") and state(b) == [("2", "y")]
    assert b.saved(rows(spark, ("7", "late")), 1, "dir-3", None) == (2, "remote") and b.saved(rows(spark, ("7", "x")), 1, None, "2025-01-01T00:00:00Z") == (2, "remote")
    assert b.saved(rows(spark, ("8", "new")), 1, "dir-4", "2024-01-05T00:00:00Z") == (3, "local") and state(b) == [("8", "new")]
    assert b.told() == {"fingerprint": "dir-4", "updated_at": "2024-01-05T00:00:00Z"}


def test_a_window_overtaken_between_reading_and_writing(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "a"))
    a.saved(rows(spark, ("1", "x")), 0, "d", "2024-01-01T00:00:00Z")
    publish, left = Archive._publish, [2]

    def overtaken(self, segments):
        if left[0]:
            left[0] -= 1
            n = left[0]
            left[0], keep = 0, left[0]
            Archive(spark, self.path).commit_delta(rows(spark, (f"other{n}", "o")), spark.createDataFrame([], "id string"))
            left[0] = keep
        return publish(self, segments)

    monkeypatch.setattr(Archive, "_publish", overtaken)
    assert a.saved(rows(spark, ("1", "x"), ("2", "mine")), 1, "d", "2024-01-01T00:00:00Z") == (4, "both")
    assert state(a) == [("1", "x"), ("2", "mine"), ("other0", "o"), ("other1", "o")]
    folders = {p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("v=")}
    assert folders == {s["folder"] for s in a.manifest()}  # what lost the race is gone


def test_the_first_version_is_a_snapshot(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    a.commit(rows(spark, ("1", "x"), ("2", None)))
    assert [s["kind"] for s in a.manifest()] == ["snapshot"] and a.verify() == []
    assert "Aggregate" not in a.snapshot()._jdf.queryExecution().executedPlan().toString()
    assert a.commit_delta(rows(spark).limit(0), spark.createDataFrame([], "id string")) == 1
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("v=")]) == 1


def test_a_delta_reads_what_it_names(spark, tmp_path, monkeypatch):
    """Deltas go without the whole state: of what they do not name, only ids are read."""
    a, ids = Archive(spark, str(tmp_path / "a")), lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    whole = Archive.snapshot
    monkeypatch.setattr(Archive, "snapshot", lambda self: pytest.fail("the whole state is read"))
    a.commit_delta(rows(spark, ("1", "x"), ("2", "y"), ("4", "w")), ids())
    a.commit_delta(rows(spark, ("3", "z"), ("4", "v")), ids("1", "7"))
    plan = lambda *x: a._named(a.manifest(), ids(*x))._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, a._named(a.manifest(), ids("1", "2", "4", "8")).collect())) == [("2", "y"), ("4", "v")]
    assert (plan("8").count("FileScan"), plan("2").count("FileScan"), plan("1", "2").count("FileScan")) == (0, 1, 2)
    last = a.commit_delta(rows(spark, ("2", "y"), ("1", "again"), ("5", "u")), ids("2", "3", "8"))
    assert {(r.id, r.op) for r in a.changes(last - 1).collect()} == {("1", "upsert"), ("5", "upsert"), ("3", "delete")}
    assert a._count(a.manifest()) == 4
    monkeypatch.setattr(Archive, "snapshot", whole)
    assert state(a) == [("1", "again"), ("2", "y"), ("4", "v"), ("5", "u")] and a.verify() == []


def test_a_delta_runs_as_many_jobs_over_many_segments_as_over_few(spark, tmp_path, monkeypatch):
    a, none = Archive(spark, str(tmp_path / "a")), spark.createDataFrame([], "id string")
    monkeypatch.setattr(Archive, "_count", lambda *_: pytest.fail("rows are counted that the manifest tells"))
    monkeypatch.setattr("chatloom.operators.archive.COMPACT_LEAST", 1)
    jobs = []
    for i in range(9):
        spark.sparkContext.setJobGroup(f"delta {i}", "")
        a.commit_delta(rows(spark, (f"new {i}", "x")), none)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"delta {i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert a.manifest()[-1]["held"] == 9 == a.snapshot().count()
    assert jobs[3:] == [jobs[3]] * 6


def test_the_manifest_tells_how_many_rows_there_are(spark, tmp_path):
    a, ids = Archive(spark, str(tmp_path / "a")), lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    a.commit_delta(rows(spark, ("1", "x"), ("2", "y"), ("4", "w")), ids())
    a.commit_delta(rows(spark, ("3", "z"), ("4", "v"), ("2", "y")), ids("1", "7", "3"))  # one is new, one other, one as it was; one goes
    a.commit_delta(rows(spark, ("1", "back")), ids())
    assert [(s["held"], a._count(a.manifest()[: i + 1])) for i, s in enumerate(a.manifest())] == [(3, 3), (3, 3), (4, 4)]
    a.commit(rows(spark, ("9", "x")))  # a whole state is not counted until it has to be
    assert "held" not in a.manifest()[-1] and a._count(a.manifest()) == 1
    a.compact()
    assert [s["held"] for s in a.manifest()] == [1] and state(a) == [("9", "x")] and a.verify() == []


def test_segments_without_columns_in_their_manifest(spark, tmp_path, monkeypatch):
    """As older versions wrote them: their files tell."""
    a, none = Archive(spark, str(tmp_path / "a")), spark.createDataFrame([], "id string")
    written = Archive._written
    with monkeypatch.context() as m:
        m.setattr(Archive, "_written", lambda *x: {k: v for k, v in written(*x).items() if k not in ("schema", "held")})
        a.commit_delta(rows(spark, ("1", "x"), ("2", "y")), none)
        a.commit_delta(rows(spark, ("3", "z")), none)
    a.commit_delta(rows(spark, ("2", "other"), ("3", "z")), spark.createDataFrame([("1",)], "id string"))
    assert ["schema" in s for s in a.manifest()] == [False, False, True] and a._count(a.manifest()) == 2
    assert state(a) == [("2", "other"), ("3", "z")] and a.verify() == []
