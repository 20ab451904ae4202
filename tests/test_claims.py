from pyspark.sql import functions as F

from chatloom.functions import claims as C
from chatloom.functions import normalize as N
from chatloom.operators import ensemble, people

c = F.col


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_categories_scores_and_guards(spark):
    df = rows(spark, "kind string, text string, quote string, stability string", ("preference", "喜欢茶", "我喜欢喝茶真的", "persistent"), ("event", "明天取件", "好！", "single"), ("fact", "some thing", "words of it", "repeated"), ("event", "一起吃饭", "我们一起吃饭", "single"))
    of = C.category(c("kind"), c("text"), c("quote"))
    got = df.select(of.alias("of"), C.score(c("kind"), c("text"), c("quote"), c("stability"), of).alias("s"), C.overstates(c("text"), c("quote")).alias("o"), C.eligible(of).alias("e")).collect()
    assert [tuple(r) for r in got] == [("preference", 14, False, True), ("temporary", -4, False, False), ("background", 7, False, True), ("interaction", 11, False, True)]
    assert rows(spark, "t string, q string", ("总是迟到", "迟到了")).select(C.overstates(c("t"), c("q"))).first()[0]


def test_anchors_numbers_and_notes(spark):
    df = rows(spark, "p string, t string, q string", ("她在图书馆学习。常去!", "图书馆学习", "我常去图书馆"), ("别的事。图书馆学习", "图书馆学习", ""), ("", "x", "y"))
    assert [r[0] for r in df.select(C.all_anchored(c("p"), c("t"), c("q"))).collect()] == [False, False, False]
    assert rows(spark, "p string", ("在图书馆学习。去了图书馆",)).select(C.all_anchored(c("p"), F.lit("图书馆学习"), F.lit("我常去图书馆"))).first()[0]
    assert rows(spark, "p string", ("25岁，住3年，第 7 次",)).select(C.unsupported_numbers(c("p"), F.lit("她25岁 3年"))).first()[0] == ["7"]
    got = rows(spark, "p string, n string", ("abcdef", "xx bcde"), ("abcdef", "xx bcdx"), ("abc", "ab"), ("abc", "a"), ("abc", "")).select(C.uses_notes(c("p"), c("n"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False]


def test_texts_and_names(spark):
    df = rows(spark, "t string", ("曾经去过",), ("现在去",))
    assert [r[0] for r in df.select(C.past_tense(c("t"))).collect()] == [True, False]
    assert [r[0] for r in rows(spark, "t string", (" fine ",), ("Diagnosis: x",), (None,)).select(C.not_clinical(c("t"), 3)).collect()] == ["fin", "Dia", ""]
    assert rows(spark, "t string", ("has a diagnosis",)).select(C.not_clinical(c("t"), 100)).first()[0] == ""
    names = rows(spark, "t string", ("Logs",), ("",), ("Ann",), (None,))
    assert [r[0] for r in names.select(C.usable_name(c("t"))).collect()] == [False, False, True, False]
    assert rows(spark, "t string", ("private_ Bo ",)).select(C.display_name(c("t"))).first()[0] == "Bo"
    assert [r[0] for r in rows(spark, "t string", ("Ann： hi",), ("System: x",), ("no colon",)).select(N.provider(c("t"))).collect()] == ["Ann", None, None]


def test_fields(spark):
    df = rows(spark, "t string, g string, p array<string>", ("去图书馆", None, None), ("x", "romance", None), ("x", "odd", ["校园平台"]), ("和朋友约会", None, None), ("x", None, None))
    assert [r[0] for r in df.select(N.task_category(c("t"), c("g"), c("p"))).collect()] == ["study", "romance", "campus", "romance", "life"]
    assert [r[0] for r in rows(spark, "h double", (-1.0,), (7.3,), (99.0,), (None,)).select(N.sleep_hours(c("h"))).collect()] == [0.0, 7.5, 24.0, None]
    assert [r[0] for r in rows(spark, "i long, o long, t long", (1, 2, None), (None, None, 9), (None, None, None)).select(N.usage_total(c("i"), c("o"), c("t"))).collect()] == [3, 9, None]
    assert [r[0] for r in rows(spark, "x double", (0.0,), (7.9,), (1e9,), (None,)).select(N.concurrency(c("x"))).collect()] == [1, 7, 64, 4]
    got = rows(spark, "r long, k string", (None, "museum"), (400, "x"), (100, "City")).select(N.search_precision(c("r"), c("k"))).collect()
    assert [r[0] for r in got] == ["exact", "approximate", "approximate"]


def test_people_are_removed_everywhere(spark):
    cards = rows(spark, "id string, keys array<string>", ("p1", ["c1", "c2"]), ("p2", ["c3"]))
    tasks = rows(spark, "id string, people array<string>", ("t1", ["p2", "p1"]), ("t2", ["p2"]), ("t3", None))
    left, kept, hidden = people.removed(cards, tasks, rows(spark, "key string", ("c9",)), rows(spark, "id string", ("p1",)))
    assert [r.id for r in left.collect()] == ["p2"] and {r.key for r in hidden.collect()} == {"c1", "c2", "c9"}
    assert {r.id: r.people for r in kept.collect()} == {"t1": ["p2"], "t2": ["p2"], "t3": None}


def test_nameless_counterparts(spark):
    said = rows(spark, "id string, key string, speaker string, speaker_role string", ("1", "a", None, "other"), ("2", "a", "me", "self"), ("3", "b", "Bo", "other"), ("4", "b", None, "other"))
    names = rows(spark, "key string, returned string, expected string", ("a", "An n", "ann"), ("b", "Zed", "Zed"))
    assert [tuple(r) for r in people.counterpart_rows(said, names).collect()] == [("1", "a", "conversation")]


def test_observation_ids_do_not_hang_on_order(spark):
    one = [("s2", "a b"), ("s1", "c")]
    df = rows(spark, "kind string, text string, evidence array<struct<source_id:string,quote:string>>", ("habit", "A b", one), ("habit", "ab ", one[::-1]), ("fact", "ab", one))
    ids = [r[0] for r in df.select(people.observation_id("kind", "text", "evidence")).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("self-observation-")


def test_states_of_clusters(spark):
    data = [("o1", "x", "rejected", "s1"), ("o2", "y", "rejected", "s1"), ("o1", "x", "accepted", "s2"), ("o2", "y", "accepted", "s2"), ("o3", "x", "needs-review", "s3"), ("o4", "x", "accepted", "s4"), ("", "x", "accepted", "s4")]
    got = ensemble.clusters(rows(spark, "observation string, participant string, validation string, source_id string", *data)).collect()
    assert {r.source_id: r.state for r in got} == {"s1": "rejected", "s2": "corroborated", "s3": "needs-review", "s4": "single-source"}
