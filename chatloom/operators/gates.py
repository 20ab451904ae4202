"""Gates that candidates pass, with a reason for each that does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import age_days, local_time, trimmed
from chatloom.operators.segments import BLOCK, placed
from chatloom.sources.staging import staged

# Words and patterns that results depend on.
DIRECT = r"(?:请你|麻烦你|需要你|你(?:要|去|得|需要|记得|别忘|先)|别忘了)"
ABSOLUTE_DATE = r"20\d{2}\s*(?:年|[-/.])\s*\d{1,2}\s*(?:月|[-/.])\s*\d{1,2}"
TRANSIENT = "快递|取件|取货|取餐|外卖|包裹|验证码|签到|临时码|柜.*件"
SUBMISSION = "提交|投稿|征集|报名|问卷|填表|经验分享|上传材料|交材料"
OTHER_OFFERS = r"(?:我|俺).{0,6}(?:请|邀请|带|陪|帮)你"
SELF_OFFERS = r"(?:我|俺).{0,6}(?:请|邀请|带|陪|帮)(?:你|他|她)"
REVERSED_TITLE = r"(?:^|开学后|之后|到时).{0,8}(?:请|邀请).{0,24}(?:喝|吃|见面|玩|台球|咖啡)"
ACTION_WORDS = (
    "需要 记得 别忘 截止 提交 报名 缴费 预约 约 见面 会议 上课 作业 论文 考试 购买 取件 归还 还书 回复 回信 联系 确认 安排 准备 申请 领取 报到 选课 "
    "签到 打卡 维修 发送 发给 整理 填写 上传 下载 办理 提醒 计划 明天 后天 下周 周一 周二 周三 周四 周五 周六 周日"
).split()
NOISE_WORDS = "哈哈 哈哈哈 嗯嗯 好的 好呀 收到 谢谢 不客气 在吗 早安 晚安 ok 好滴 笑死".split()
DATED = r"\d{1,2}[月\-/]\d{1,2}|\d{1,2}:\d{2}|今天|明天|后天|本周|下周"
ASKING = r"[?？]|请|麻烦|能否|帮忙"
#: Days after which passing and submission tasks are over.
POLICY = {"strict": (2, 14), "balanced": (4, 30), "broad": (7, 60)}


def expired(candidates: DataFrame, as_of: str, policy: str = "balanced", latest: str = "latest_ts") -> Column:
    """Whether a candidate (start_at, due_at, title, description) is over; `latest` is the time of its latest evidence."""
    now = F.lit(as_of).cast("timestamp_ntz")
    today = F.date_trunc("day", now).cast("timestamp_ntz")
    start, due = local_time(F.col("start_at")), local_time(F.col("due_at"), end_of_day=True)
    passing, submission = POLICY[policy]
    age = age_days(F.col(latest), as_of)
    text = F.concat_ws(" ", "title", "description")
    return F.coalesce(
        F.when(due < today, True)
        .when((start < today) & (due.isNull() | (due < now)), True)
        .when((start >= today) | (due >= today), False)
        .when(text.rlike(TRANSIENT) & (age > passing), True)
        .when(text.rlike(SUBMISSION) & F.col("due_at").isNull() & (age > submission), True),
        F.lit(False),
    )


def evidence(candidate_sources: DataFrame, messages: DataFrame) -> DataFrame:
    """What a candidate's cited messages say, a row each: owned, latest_ts, other_offers, self_offers, n_sources. candidate_sources: id, source_id."""
    said = messages.select(F.col("id").alias("source_id"), "speaker_role", "content", "captured_ts")
    cited = candidate_sources.select("id", "source_id").distinct().join(said, "source_id")
    return cited.groupBy("id").agg(
        F.bool_or((F.col("speaker_role") == "self") | ((F.col("speaker_role") == "other") & F.col("content").rlike(DIRECT))).alias("owned"),
        F.max("captured_ts").alias("latest_ts"),
        F.bool_or((F.col("speaker_role") == "other") & F.col("content").rlike(OTHER_OFFERS)).alias("other_offers"),
        F.bool_or((F.col("speaker_role") == "self") & F.col("content").rlike(SELF_OFFERS)).alias("self_offers"),
        F.bool_or(F.col("captured_ts").isNotNull() | F.col("content").rlike(ABSOLUTE_DATE)).alias("anchored"),
        F.count("*").alias("n_sources"),
    )


def judged(candidates: DataFrame, proof: DataFrame, as_of: str, policy: str = "balanced") -> DataFrame:
    """candidates with the first reason against each: evidence, ownership, time, shape, expired, direction; null if it passes."""
    rows = candidates.join(proof, "id", "left")
    shapely = (F.length(trimmed("title")) >= 2) & (F.length(trimmed("description")) >= 2)
    reversed_ = F.col("other_offers") & ~F.col("self_offers") & F.col("title").rlike(REVERSED_TITLE)
    reason = (
        F.when(F.col("n_sources").isNull(), "evidence")
        .when(~F.col("owned"), "ownership")
        .when(~F.col("anchored"), "time")
        .when(~shapely, "shape")
        .when(expired(rows, as_of, policy), "expired")
        .when(reversed_, "direction")
    )
    return rows.withColumn("reason", reason)


def action_score(text: Column) -> Column:
    """How much a text asks for something to be done."""
    low = F.lower(text)
    score = F.lit(0)
    for word in ACTION_WORDS:
        score = score + F.when(F.contains(low, F.lit(word)), 2 if len(word) > 1 else 1).otherwise(0)
    bare = trimmed(low)
    noise = F.lit(False)
    for word in NOISE_WORDS:
        noise = noise | (bare == word) | ((F.length(low) < 18) & low.startswith(word))
    return score + F.when(low.rlike(DATED), 2).otherwise(0) + F.when(low.rlike(ASKING), 1).otherwise(0) + F.when(F.length(low).between(15, 220), 1).otherwise(0) - F.when(noise, 4).otherwise(0)


def task_like(messages: DataFrame, least: int = 3, shortest: int = 8) -> DataFrame:
    """Messages that look like tasks, one of each 120-character key, with their score."""
    rows = messages.withColumn("score", action_score(F.col("content"))).where((F.col("score") >= least) & (F.length(trimmed("content")) >= shortest))
    key = F.substring(F.lower(F.regexp_replace("content", r"[\s\p{P}\p{S}]+", "")), 1, 120)
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.col("captured_ts").desc_nulls_last(), "id"))
    return rows.withColumn("key", key).withColumn("nth", best).where("nth = 1").drop("nth", "key")


def kept_within(files: DataFrame, most: int, most_bytes: int, by: str, block: int = BLOCK) -> DataFrame:
    """Files (by, name, at, bytes) that are kept, newest first (without a time last), while there are fewer than `most` and their
    bytes stay within `most_bytes`; one that is too large is passed over and later, smaller ones may stay.

    The order matters. Folders of up to `block` files are folded as a short array. Larger ones go in rounds over sorted ranges:
    what is larger than the room left can never stay; of the rest the longest run that fits does, found by sums of blocks; the
    one after it is passed over, and the next round goes on behind it. A round keeps at least one file, and takes all folders."""
    rows = files.select(F.to_json(F.struct(by)).alias("folder"), F.col(by), "name", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("newest"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    sizes = rows.groupBy("folder").agg(F.count("*").alias("n"))
    large = staged(sizes.where(F.col("n") > block).select("folder"), "large_folders")
    if large.isEmpty():
        return _kept_small(rows, most, most_bytes, by)
    return _kept_small(rows.join(large, "folder", "left_anti"), most, most_bytes, by).unionByName(_kept_large(rows.join(large, "folder", "left_semi"), most, most_bytes, by, block))


def _kept_small(rows: DataFrame, most: int, most_bytes: int, by: str) -> DataFrame:
    file = F.struct(F.col("newest").isNull().alias("undated"), "newest", "name", "bytes")
    each = rows.groupBy("folder").agg(F.first(by).alias(by), F.array_sort(F.collect_list(file)).alias("files"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))

    def take(s, f):
        fits = (s["n"] < most) & (s["used"] + f["bytes"] <= most_bytes)
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["used"] + F.when(fits, f["bytes"]).otherwise(0)).alias("used"), F.when(fits, F.concat(s["names"], F.array(f["name"]))).otherwise(s["names"]).alias("names"))

    folded = each.withColumn("kept", F.aggregate("files", begin, take))
    return folded.select(by, F.col("kept.n").cast("long").alias("kept"), F.col("kept.used").alias("bytes"), F.array_join("kept.names", ",").alias("names"))


def _kept_large(rows: DataFrame, most: int, most_bytes: int, by: str, block: int) -> DataFrame:
    numbered = placed(rows, "folder", [F.col("newest").asc_nulls_last(), F.col("name"), F.col("bytes")]).withColumn("block", F.floor(F.col("place") / block))
    numbered = staged(numbered.select("folder", by, "name", "bytes", "place", "block"), "files")
    state = staged(numbered.groupBy("folder").agg(F.lit(-1).cast("long").alias("after"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used")), "rounds")
    kept = None
    while True:
        open_ = numbered.join(state, "folder").where((F.col("place") > F.col("after")) & (F.col("n") < most) & (F.col("used") + F.col("bytes") <= most_bytes))
        earlier = Window.partitionBy("folder").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = open_.groupBy("folder", "block").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"), F.first("n").alias("n"), F.first("used").alias("used"))
        sums = sums.withColumns({"c0": F.col("n") + F.coalesce(F.sum("c").over(earlier), F.lit(0)), "b0": F.col("used") + F.coalesce(F.sum("b").over(earlier), F.lit(0))})
        whole = (F.col("c0") + F.col("c") <= most) & (F.col("b0") + F.col("b") <= most_bytes)
        sums = staged(sums.withColumn("whole", whole).select("folder", "block", "c0", "b0", "whole"), "rounds")
        # sums only rise, so the whole blocks are the first ones, and the next is the only one that is looked into
        edge = sums.where("NOT whole").groupBy("folder").agg(F.min("block").alias("block"))
        inside = open_.drop("n", "used").join(sums.join(edge, ["folder", "block"], "left_semi").drop("whole"), ["folder", "block"])
        so_far = Window.partitionBy("folder", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.withColumns({"c": F.col("c0") + F.count("*").over(so_far), "b": F.col("b0") + F.sum("bytes").over(so_far)})
        inside = staged(inside.withColumn("fits", (F.col("c") <= most) & (F.col("b") <= most_bytes)).select("folder", by, "name", "bytes", "place", "fits"), "rounds")
        ahead = open_.join(sums.where("whole"), ["folder", "block"], "left_semi").select("folder", by, "name", "bytes", "place")
        now = staged(ahead.unionByName(inside.where("fits").drop("fits")), "kept")
        kept = now if kept is None else kept.unionAll(now)
        stops = inside.where("NOT fits").groupBy("folder").agg(F.min("place").alias("stop"))
        if stops.isEmpty():
            break
        more = now.groupBy("folder").agg(F.count("*").alias("more"), F.sum("bytes").alias("more_bytes"))
        state = state.join(stops, "folder").join(more, "folder", "left")
        state = staged(state.select("folder", F.col("stop").alias("after"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("used") + F.coalesce("more_bytes", F.lit(0))).alias("used")), "rounds")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",")  # `most` at most
    found = kept.groupBy("folder").agg(F.count("*").alias("kept"), F.sum("bytes").alias("bytes"), names.alias("names"))
    folders = numbered.groupBy("folder").agg(F.first(by).alias(by))
    return folders.join(found, "folder", "left").select(by, F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.coalesce("names", F.lit("")).alias("names"))
