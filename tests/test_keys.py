"""Keys, trimming and order of texts beyond ASCII."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from chatloom.functions.columns import UNLETTERED, WHITE, blank_as_null, compact_key, in_locale, text_key, trimmed
from chatloom.operators import persons

SPACE = f"[{WHITE}]+"


def compact(text):
    text = unicodedata.normalize("NFKC", text).lower()
    return re.sub(SPACE, "", "".join(c for c in text if unicodedata.category(c)[0] not in "PS"))


TEXTS = ["Ann Lee", "Ann　Lee", "Ann Lee", "ＡＮＮ　ＬＥＥ", "ｶﾞｷﾞ ｱ", "ガギ ア", "①②", "⑩", "ﬁne", "é", "é", "x²", "㍿", "½", "한글", "한", "。！？", "\n\n", "　 \t", "", "A﻿b", "𝐀b", "İ", "क़", "Ⅻ", "豈"]


def test_compact_keys_are_compatible(spark):
    rng = random.Random(5)
    # marks and symbols of which two versions of Unicode may think differently are left out
    drawn = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x3400), *range(0xF900, 0x10000)) if unicodedata.category(chr(c))[0] in "LNMZ" and not {unicodedata.category(x)[0] for x in unicodedata.normalize("NFKC", chr(c))} & {"S", "C", "P"}]
    texts = TEXTS + ["".join(rng.choice(drawn) for _ in range(8)) for _ in range(1500)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", compact_key(F.col("t")).alias("k")).collect()
    found = {r.i: r.k for r in rows}
    assert found.pop(-1) is None
    wrong = [(t, found[i], compact(t)) for i, t in enumerate(texts) if found[i] != compact(t)]
    assert len(wrong) <= 8 and not [w for w in wrong if w[0] in TEXTS], wrong  # small letters of two versions


def test_white_space_of_any_kind(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r for r in df.select("i", text_key(F.col("t")).alias("k"), trimmed("t").alias("b"), blank_as_null(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].b == t.strip(WHITE) and (got[i].n is None) == (t.strip(WHITE) == "")
        assert got[i].k == re.sub(SPACE, "", t).lower() or t == "İ"
    titles = spark.createDataFrame([("\n\n　",), ("ok title",)], "title string")
    assert titles.where(blank_as_null(F.col("title")).isNotNull()).count() == 1


def test_names_in_the_order_of_their_language(spark):
    # by pinyin, and before that letters without regard to case first
    names = ["张三", "阿明", "李四", "bob", "Bob", "Ann", "王五", "éva", "Zoe"]
    df = spark.createDataFrame([(n, None, 0, 0) for n in names], "name string, last_ts timestamp, sources int, conversations int")
    got = [r.name for r in persons.ordered(df, "name").collect()]
    assert [n for n in got if n[0] > "一"] == ["阿明", "李四", "王五", "张三"]
    assert [n for n in got if n[0] < "一"] == ["Ann", "bob", "Bob", "éva", "Zoe"]
    by_code = [r.name for r in df.orderBy("name").collect()]
    assert by_code != got
    assert [r.name for r in df.orderBy(in_locale("name")).collect()] == got


def test_people_are_searched_in_all_that_is_shown(spark):
    rows = [("Ann", ["Chat"], ["plays Chess"], [], None, None, "2024-01-01"), ("Bo", [], [], ["Tea"], "Quiet　person", None, None), ("Cy", None, None, None, None, "met in PARIS", "2024-01-02")]
    df = spark.createDataFrame(rows, "name string, platforms array<string>, facts array<string>, preferences array<string>, portrait string, notes string, last_ts string")
    names = lambda text, most=9: [r.name for r in persons.searched(df, text, most).collect()]
    assert [names(t) for t in ("chess", " tea　", "quiet", "paris", "chat", "bo", "none")] == [["Ann"], ["Bo"], ["Bo"], ["Cy"], ["Ann"], ["Bo"], []]
    assert names("") == ["Cy", "Ann", "Bo"] and names(" ", 1) == ["Cy"]


def test_unlettered_is_punctuation_symbols_and_white_space(spark):
    """The pattern against the plain one, over every code point."""
    chars = spark.createDataFrame([(f"a{chr(c)}b{chr(c)}{chr(c)}",) for c in range(0x110000) if not 0xD800 <= c < 0xE000], "s string")
    plain = rf"[\p{{P}}\p{{S}}{WHITE}]+"
    assert chars.where(F.regexp_replace("s", UNLETTERED, "") != F.regexp_replace("s", plain, "")).isEmpty()
    assert chars.where(F.regexp_replace("s", UNLETTERED, "") != F.col("s")).count() > 8000
