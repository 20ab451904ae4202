"""Fields of tasks, places, check-ins, attachments and usage made uniform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.columns import blank_as_null, trimmed

# Words and patterns that results depend on.
NO_PROVIDER = "text message content 内容 聊天记录 系统 system".split()
TASK_CATEGORIES = (
    ("romance", "恋爱|情侣|约会|表白|恋人|对象|纪念日"),
    ("campus", "校园|学校|大学|学院|开学|选课|课程|校务|报到|社团|宿舍"),
    ("friends", "朋友|同学|聚会|聚餐|见面|联络|聊天|回信|回复"),
    ("study", "学习|阅读|作业|论文|考试|复习|练习|图书馆|写作"),
    ("wellbeing", "健康|训练|锻炼|运动|医院|睡眠|休息|恢复|心理"),
)
CAMPUS_SOURCE = "校园平台"
PLACE_CATEGORIES = (("study", "学校|校园|课程|开学|返校|考试|学习|提交"), ("health", "医院|健康|训练|锻炼|运动|恢复"), ("social", "见面|约会|朋友|聚会|喝酒|吃饭|咖啡"))
AREA = r"(?i)city|town|village|county|district|state|province|region|locality|administrative"
IMAGES, TEXTS = "png jpg jpeg webp gif avif".split(), "json csv txt md".split()
METRES_A_DEGREE = 111_320


def provider(summary: Column) -> Column:
    """The name before the first colon, if it is one."""
    name = blank_as_null(trimmed(F.regexp_extract(summary, r"^([^:：\n]{1,48})[:：]\s*", 1)))
    return F.when(~F.lower(name).isin(NO_PROVIDER), name)


def task_category(text: Column, given: Column, platforms: Column) -> Column:
    """The category given, else the first whose words the text has."""
    known = [c for c, _ in TASK_CATEGORIES] + ["life"]
    out = F.when(given.isin(known), given)
    for name, words in TASK_CATEGORIES:
        has = text.rlike(words)
        out = out.when(has | F.coalesce(F.array_contains(platforms, CAMPUS_SOURCE), F.lit(False)) if name == "campus" else has, name)
    return out.otherwise("life")


def place_category(text: Column) -> Column:
    out = None
    for name, words in PLACE_CATEGORIES:
        out = F.when(text.rlike(words), name) if out is None else out.when(text.rlike(words), name)
    return out.otherwise("explore")


def search_radius(lat: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Half the larger side of a box in metres, from 120 to 100,000; null for none."""
    high = F.abs(north - south) * METRES_A_DEGREE
    wide = F.abs(east - west) * METRES_A_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    radius = F.greatest(high, wide) / 2
    return F.when(high.isNotNull() & wide.isNotNull() & (radius > 0), F.floor(F.least(F.lit(100_000.0), F.greatest(F.lit(120.0), radius)) + 0.5).cast("long"))


def search_precision(radius: Column, kind: Column) -> Column:
    return F.when((F.coalesce(radius, F.lit(0)) >= 320) | F.coalesce(kind, F.lit("")).rlike(AREA), "approximate").otherwise("exact")


def file_class(name: Column, mime: Column) -> Column:
    """image, text or binary."""
    kind, ending = F.lower(F.coalesce(mime, F.lit(""))), F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    return F.when(kind.startswith("image/") | ending.isin(IMAGES), "image").when(kind.startswith("text/") | ending.isin(TEXTS), "text").otherwise("binary")


def attachment_totals(name: Column, mime: Column, size: Column) -> list[Column]:
    """Aggregates: files, bytes, tokens of texts (three bytes each), images, other documents."""
    bytes_, kind = F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("long"), file_class(name, mime)
    return [
        F.count("*").alias("files"),
        F.coalesce(F.sum(bytes_), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(kind == "text", F.ceil(bytes_ / 3))), F.lit(0)).alias("text_tokens"),
        F.count_if(kind == "image").alias("images"),
        F.count_if(kind == "binary").alias("binaries"),
    ]


def mood(value: Column) -> Column:
    return F.when(value.isin(1, 2, 3, 4, 5), value)


def sleep_hours(value: Column) -> Column:
    """From 0 to 24 in half hours."""
    return F.when(value.isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(24.0), value)) * 2 + 0.5) / 2)


def one_of(value: Column, *known: str, other: str = "unknown") -> Column:
    return F.when(value.isin(*known), value).otherwise(other)


def usage_total(inputs: Column, outputs: Column, reported: Column) -> Column:
    """The tokens that are reported, else those in and out; null if nothing is known."""
    some = F.coalesce(inputs, outputs, reported).isNotNull()
    return F.when(some, F.coalesce(reported, F.coalesce(inputs, F.lit(0)) + F.coalesce(outputs, F.lit(0))))


def concurrency(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), 4).otherwise(F.greatest(F.lit(1), F.least(F.lit(64), F.floor(value)))).cast("int")
