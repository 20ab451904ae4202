import json
import unicodedata

from pyspark.sql import functions as F

from chatloom.functions import claims, normalize
from chatloom.functions import columns as C
from chatloom.operators import gates, links, merge


def fnv(text):
    h = 2166136261
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = digits[d] + out
    return out or "0"


TEXTS = ["", "a", "Hello, World!", "微信导出", "😀 emoji", "tab\tand\nline", 'quote " and \\']


def test_hashes_and_lengths(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", C.fnv1a36(F.col("t")).alias("h"), C.utf16_length(F.col("t")).alias("n"), C.nfkc(F.col("t")).alias("k")).collect()
    for r in got:
        assert (r.h, r.n, r.k) == (fnv(r.t), len(r.t.encode("utf-16-be")) // 2, unicodedata.normalize("NFKC", r.t))


def test_row_sizes(spark):
    df = spark.createDataFrame([(t * k, "self") for t in TEXTS for k in (1, 40)] + [(None, None)], "content string, speaker_role string").withColumn("captured_ts", F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'"))
    for r in df.select("*", C.row_size().alias("size")).collect():
        text = (r.content or "").strip(" ")[:3000] if (r.content or "").strip() else "[non-text message]"
        row = json.dumps([0, "2024-01-02T03:04:05", text, r.speaker_role or "unknown"], ensure_ascii=False, separators=(",", ":"))
        assert r["size"] == max(64, len(row.encode("utf-16-be")) // 2 + 8)


def test_times(spark):
    want = {"1704067200": "2024-01-01T00:00:00", "1704067200000": "2024-01-01T00:00:00", "2024-02-30": None, "2024年3月4日 5时6分7秒": "2024-03-04T05:06:07", "at 2024/3/4 00:00 or so": "2024-03-04", "2024-01-02T08:00:00.000Z": "2024-01-02T08:00:00", "": None, "never": None, "2024-1-2 24:00": None, "2024-1-2 10:61": None}
    df = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string").select("t", C.captured_at(F.col("t")).alias("at"))
    assert {r.t: r["at"] for r in df.collect()} == want | {None: None}


def test_unions_cursors_grams(spark):
    df = spark.createDataFrame([(["b ", "a", ""], ["a", "c"], "a?b")], "x array<string>, y array<string>, z string")
    r = df.select(C.union_of(F.col("x"), F.col("y"), most=2).alias("u"), C.cursor_of(F.col("z")).alias("c"), C.char_grams(F.lit("Ab cd!")).alias("g")).first()
    assert r.u == ["b", "a"] and r.g == ["abc", "bcd", "ab", "bc", "cd"] and set(r.c) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def test_gates(spark):
    rows = spark.createDataFrame(
        [("a", "Buy milk", "soon", None, None, "m1"), ("b", "Buy milk", "soon", "2024-01-01", None, "m1"), ("c", "取快递", "柜里", None, None, "m1"), ("d", "提交材料", "x y", None, None, "m2"), ("e", "Buy", "it", None, "2024-02-01", "m3"), ("f", "Go", "on", None, None, "m9"), ("g", "Go", "on", None, None, "m4")],
        "id string, title string, description string, start_at string, due_at string, source_id string",
    )
    said = spark.createDataFrame([("m1", "self", "x", "2024-01-10 00:00:00"), ("m2", "other", "请你提交", "2023-11-01 00:00:00"), ("m3", "other", "hello", "2024-01-10 00:00:00"), ("m4", "self", "x", None)], "id string, speaker_role string, content string, at string").withColumn("captured_ts", F.to_timestamp_ntz("at"))
    got = {r.id: r.reason for r in gates.judged(rows.drop("source_id"), gates.evidence(rows.select("id", "source_id"), said), "2024-01-20 00:00:00").collect()}
    assert got == {"a": None, "b": "expired", "c": "expired", "d": "expired", "e": "ownership", "f": "evidence", "g": "time"}


def test_candidate_fold_keeps_its_order(spark):
    rows = [("a", 1, "Call Bo", "soon", "s1", None, None), ("b", 2, "call bo!", "Soon.", "s2", "2024-01-01", None), ("c", 3, "Call Bo", "other", "s2", "2024-01-02", None), ("d", 4, "Call Bo", "other", "s2", None, None), ("e", 5, "Else", "other", "s9", None, None)]
    df = spark.createDataFrame(rows, "id string, ord long, title string, description string, source_id string, start_at string, place string").withColumn("location_precision", F.lit("unknown"))
    got = {r.id: (r.absorbed, r.sources) for r in merge.merged_candidates(df).collect()}
    # b joins a and brings its date and source; c has another date; d shares s2 and the title with a, the first that it equals
    assert got == {"a": (2, "s1,s2"), "c": (0, "s2"), "e": (0, "s9")}


def test_text_keys_see_whole_messages(spark, tmp_path):
    """The query against brute force over messages of which only the ends differ."""
    import re

    from chatloom import catalog

    start = "The same opening words, longer than forty characters: "
    texts = [start + "One", start + "two, 2", "Ab cd!", "", None, "你好 世界。" * 9]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: r for r in catalog.QUERIES["text_keys"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        plain = re.sub(r"\s+", "", t or "").lower()
        runs = [plain[j : j + n] for n in (3, 2) for j in range(len(plain) - n + 1)]
        grams = list(dict.fromkeys(g for g in runs if re.fullmatch(r"[一-鿿A-Za-z0-9]+", g)))[:36]
        r = got[f"m-{i}-0"]
        assert r.grams == "|".join(grams)
        assert r.compact == (None if t is None else re.sub(r"[\W_]+", "", t).lower())
    assert got["m-0-0"].compact != got["m-1-0"].compact
    assert len(got["m-0-0"].grams.split("|")) == 36


def test_full_width_keys_are_plain_ones(spark):
    rows = spark.createDataFrame([("ＡＢＣ　１２３！ｘ",), ("abc 123 x",)], "t string")
    assert {r.k for r in rows.select(C.compact_key(F.col("t")).alias("k")).collect()} == {"abc123x"}


def test_small_functions(spark):
    rows = spark.createDataFrame([("医院 7", {"homeAddress": "x", "placeTag": "home", "lat": "1", "steps": "9"}, "b", "2024-01-10 12:00:00")], "t string, m map<string,string>, k string, at string")
    got = rows.select(
        normalize.place_category(F.col("t")).alias("place"),
        links.hidden_values(F.col("m")).alias("left"),
        normalize.one_of(F.col("k"), "a", "b").alias("one"),
        normalize.one_of(F.col("k"), "a").alias("other"),
        claims.whole_days(F.col("at").cast("timestamp_ntz"), "2024-01-20 00:00:00").alias("days"),
    ).first()
    assert (got.place, got.left, got.one, got.other, got.days) == ("health", {"placeTag": "home", "steps": "9"}, "b", "unknown", 9)


def test_staged_tables_go_with_their_scope(spark, tmp_path):
    import os

    from chatloom.sources.staging import new_path, scope, staged

    with scope(spark):
        path = new_path(spark, "x")
        table = staged(spark.range(3), "y")
        files = [f.replace("file://", "") for f in table.inputFiles()]
        assert table.count() == 3 and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and path
