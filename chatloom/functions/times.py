"""Times of tasks as readers see them, and the clock of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.columns import trimmed

DATE_ONLY, HAS_CLOCK = r"^\d{4}-\d{2}-\d{2}$", r"T|\s\d{1,2}:"
OFFSET = 840

# What readers see.
NO_SOURCE_TIME, NO_TARGET_TIME = "未记录信息源时间", "未在来源中明确目标时间"
PENDING, ALL_DAY = "待定", "全天"
HAPPENS, STARTS, STARTS_OR_HAPPENS, DUE, SOURCE = "发生：", "开始：", "开始/发生：", "；截止：", "信息源时间："
DUE_ALONE = "截止："
YEAR, MONTH, DAY = "年", "月", "日"


def task_time(text: Column) -> Column:
    """A task's time: a date that the calendar has, or a date and a clock; null otherwise."""
    bare = trimmed(text)
    return F.when(bare.rlike(DATE_ONLY), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")).when(bare != "", F.try_to_timestamp(bare).cast("timestamp_ntz"))


def _day(text: Column, at: Column) -> Column:
    """The day of a time, with its clock if the text has one; the text itself if it is no time."""
    day = F.concat(F.year(at).cast("string"), F.lit(YEAR), F.month(at).cast("string"), F.lit(MONTH), F.dayofmonth(at).cast("string"), F.lit(DAY))
    shown = F.when(text.rlike(HAS_CLOCK), F.concat(day, F.lit(" "), F.date_format(at, "HH:mm"))).otherwise(day)
    return F.coalesce(shown, F.when(trimmed(text) != "", trimmed(text)), F.lit(NO_SOURCE_TIME))


def labelled_tasks(tasks: DataFrame) -> DataFrame:
    """tasks (start_at, due_at, source_at: texts) with target, what they state of their start and deadline (their sources' times are
    no target), told, the same or else their sources' time, clock, and day, under which they stand in a timeline.

    Each time is parsed once, in a column of its own, so the expressions stay small."""
    names = ("start_at", "due_at", "source_at")
    rows = tasks.withColumns({f"{n}_is": task_time(F.col(n)) for n in names})
    rows = rows.withColumns({f"{n}_day": _day(F.col(n), F.col(f"{n}_is")) for n in names} | {f"{n}_set": F.coalesce(F.col(n) != "", F.lit(False)) for n in names})
    start, due, source = (F.col(f"{n}_day") for n in names)
    has_start, has_due, has_source = (F.col(f"{n}_set") for n in names)
    once = F.concat(F.lit(HAPPENS), start)
    alone = F.when(has_start, F.concat(F.lit(STARTS_OR_HAPPENS), start)).when(has_due, F.concat(F.lit(DUE_ALONE), due))
    both, same = has_start & has_due, F.col("start_at") == F.col("due_at")
    target = F.when(both & same, once).when(both, F.concat(F.lit(STARTS), start, F.lit(DUE), due)).otherwise(F.coalesce(alone, F.lit(NO_TARGET_TIME)))
    from_source = F.when(has_source, F.concat(F.lit(SOURCE), source)).otherwise(NO_SOURCE_TIME)
    told = F.when(both & same, once).when(both, F.concat(F.lit(STARTS_OR_HAPPENS), start, F.lit(DUE), due)).otherwise(F.coalesce(alone, from_source))
    text = F.when(has_start, F.col("start_at")).when(has_due, F.col("due_at")).otherwise(F.col("source_at"))
    at = F.when(has_start, F.col("start_at_is")).when(has_due, F.col("due_at_is")).otherwise(F.col("source_at_is"))
    clock = F.when(at.isNull(), PENDING).when(text.rlike(HAS_CLOCK), F.date_format(at, "HH:mm")).otherwise(ALL_DAY)
    out = rows.withColumns({"target": target, "told": told, "clock": clock, "day": F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(NO_SOURCE_TIME))})
    return out.drop(*[f"{n}_{x}" for n in names for x in ("is", "day", "set")])


def offset_label(minutes: Column) -> Column:
    """An offset from UTC, at most OFFSET minutes either way."""
    whole = F.greatest(F.lit(-OFFSET), F.least(F.lit(OFFSET), F.floor(minutes + F.lit(0.5)).cast("int")))
    far = F.abs(whole)
    return F.when(minutes.isNull() | F.isnan(minutes), "offset unknown").otherwise(F.format_string("UTC%s%02d:%02d", F.when(whole < 0, "-").otherwise("+"), F.floor(far / 60).cast("int"), far % 60))


def zones(spark: SparkSession) -> DataFrame:
    """zone: the names of time zones that Spark's functions take, some six hundred."""
    from zoneinfo import available_timezones

    return spark.createDataFrame([(z,) for z in sorted(available_timezones()) if "/" in z or z == "UTC"], "zone string")


def local_dates(rows: DataFrame, at: str, zone: str, fallback: str) -> DataFrame:
    """rows with zone (one that is known, else the fallback) and date, the day of a time (timestamp_ntz in UTC) there."""
    known = zones(rows.sparkSession).withColumn("known", F.lit(True))
    out = rows.join(F.broadcast(known), rows[zone] == known["zone"], "left").drop(known["zone"])
    out = out.withColumn(zone, F.when(F.col("known"), F.col(zone)).otherwise(F.lit(fallback))).drop("known")
    return out.withColumn("date", F.date_format(F.convert_timezone(F.lit("UTC"), F.col(zone), F.col(at)), "yyyy-MM-dd"))
