"""How claims about people are judged: expressions over a claim's text, quote, sources and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.columns import age_days, char_grams, text_key, trimmed

# Words and patterns that results depend on, and the labels that readers see.
LIKING = "喜欢|不喜欢|想要|想去|爱吃|感兴趣|习惯|常去|希望|讨厌|擅长|在意|计划|准备"
FILLER = "^(?:好|哈哈|可以|知道了|收到|嗯|行)[!！?？。,.，]*$"
CATEGORIES = (
    ("temporary", "刚才|今天|明天|下周|等会|稍后|五点|正在|待会|收快递|取件|提交|截止|报名|请假|复学"),
    ("boundary", "不要再|不要打扰|不允许|别叫|拒绝|请勿|不想要"),
    ("preference", "喜欢|不喜欢|爱吃|讨厌|感兴趣|喜欢玩|爱玩|想吃|想去|喜欢听|喜欢看"),
    ("habit", "经常|通常|习惯|每天|每周|一般会|平时"),
    ("identity", "学校|学生|工作|家人|家乡|居住|来自|专业|年级|身份"),
    ("interaction", "会|一起|见面|吃饭|打台球|请你|邀请|帮忙|联系|送你|给你买|买给你|关心|照顾|和好|加回|删好友|删除好友|拉黑|解除拉黑|重新联系|道歉|承诺"),
    ("skill", "会做|擅长|学过|会用|考试|课程|技能"),
)
STRONG = "喜欢 爱吃 热爱 经常 总是 习惯 性格 内向 外向 很独立 很温柔".split()
PAST = r"过去|当时|此前|早期|一度|曾经|曾|原先|在[^。；\n]{0,24}(?:年|月|记录|阶段)|截至[^。；\n]{0,18}"
CLINICAL = r"(?i)抑郁症|躁郁症|双相(?:情感)?障碍|焦虑症|人格障碍|精神分裂|创伤后应激(?:障碍)?|adhd|注意缺陷多动障碍|成瘾(?:症)?|自杀风险|自伤风险|diagnos(?:is|tic)|bipolar|depression disorder|anxiety disorder|personality disorder"
HARD_TOKEN = r"\d{1,4}(?:年|月|日|点|号|周|次|岁|元|公里|%|％)?"
NO_NAME = r"(?i)^(?:私聊|单聊|好友|聊天|聊天记录|messages?|data|logs?|records?)$"
NAME_PREFIX = r"(?i)^(?:私聊|单聊|direct|private|dm)[\s_-]*"
LABELS = {"none": "时间未记录", "tomorrow": "明天", "ahead": " 天后", "today": "今天", "yesterday": "昨天", "days": " 天前", "months": " 个月前", "years": " 年前"}


def both(text: Column, quote: Column) -> Column:
    return text_key(F.concat_ws(" ", text, quote))


def category(kind: Column, text: Column, quote: Column) -> Column:
    """The first category whose words a claim has."""
    hay, out = both(text, quote), None
    for name, words in CATEGORIES:
        out = F.when(hay.rlike(words), name) if out is None else out.when(hay.rlike(words), name)
    return out.otherwise(F.when(kind == "preference", "preference").otherwise("background"))


def score(kind: Column, text: Column, quote: Column, stability: Column, of: Column) -> Column:
    """How much a claim tells, by its kind, stability, words, quote and category (`of`)."""
    said = trimmed(quote)
    return (
        F.when(kind == "preference", 5).when(kind == "event", 8).otherwise(2)
        + F.when(stability == "persistent", 6).when(stability == "repeated", 4).otherwise(0)
        + F.when(both(text, quote).rlike(LIKING), 3).otherwise(0)
        + F.when(F.length(said) >= 8, 1).otherwise(0)
        - F.when(said.rlike(FILLER), 6).otherwise(0)
        - F.when(of.isin("temporary", "filler"), 6).otherwise(0)
        + F.when(of.isin("interaction", "boundary"), 3).otherwise(0)
    )


def eligible(of: Column) -> Column:
    return ~of.isin("temporary", "filler")


def overstates(text: Column, quote: Column) -> Column:
    """Whether a claim has a strong word that its one quote has not."""
    a, b = text_key(text), text_key(quote)
    return F.exists(F.array(*map(F.lit, STRONG)), lambda w: F.contains(a, w) & ~F.contains(b, w))


def anchored(sentence: Column, text: Column, quote: Column) -> Column:
    """Whether a sentence holds a claim's text or quote, or three characters of them in a row."""
    hay, t, q = text_key(sentence), text_key(text), text_key(quote)
    grams = F.filter(char_grams(text, quote), lambda g: F.length(g) >= 3)
    return ((F.length(t) >= 4) & F.contains(hay, t)) | ((F.length(q) >= 4) & F.contains(hay, q)) | F.exists(grams, lambda g: F.contains(hay, g))


def all_anchored(portrait: Column, text: Column, quote: Column) -> Column:
    """Whether every sentence of a portrait is anchored in a claim."""
    sentences = F.filter(F.split(portrait, r"[。！？!?；;\n]+"), lambda s: trimmed(s) != "")
    return (F.size(sentences) > 0) & F.forall(sentences, lambda s: anchored(s, text, quote))


def unsupported_numbers(portrait: Column, allowed: Column) -> Column:
    """Numbers, with their units, of a portrait that the allowed text has not."""
    return F.filter(F.regexp_extract_all(portrait, F.lit(HARD_TOKEN), F.lit(0)), lambda x: ~F.contains(text_key(allowed), text_key(x)))


def uses_notes(portrait: Column, notes: Column) -> Column:
    """Whether a portrait holds four characters in a row of the notes, or a whole shorter word of two or three."""
    hay = text_key(portrait)
    words = F.filter(F.split(text_key(notes), r"[^一-鿿A-Za-z0-9]+"), lambda w: F.length(w) >= 2)
    runs = F.flatten(F.transform(words, lambda w: F.when(F.length(w) < 4, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 3), lambda i: F.substring(w, i, F.lit(4))))))
    return F.exists(runs, lambda x: F.contains(hay, x))


def past_tense(text: Column) -> Column:
    return text.rlike(PAST)


def not_clinical(text: Column, most: int) -> Column:
    """A text about oneself without diagnoses; blank otherwise."""
    cut = F.substring(trimmed(text), 1, most)
    return F.when(cut.rlike(CLINICAL), "").otherwise(F.coalesce(cut, F.lit("")))


def usable_name(name: Column) -> Column:
    bare = trimmed(name)
    return F.coalesce((bare != "") & (F.length(bare) <= 120) & ~bare.rlike(NO_NAME), F.lit(False))


def display_name(name: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(F.coalesce(name, F.lit(""))), NAME_PREFIX, ""))


def relative_label(at: Column, as_of: str) -> Column:
    """How long ago, in a reader's words."""
    seconds = F.unix_timestamp(F.to_timestamp_ltz(F.lit(as_of))) - F.unix_timestamp(at.cast("timestamp"))
    days, ahead = F.floor(seconds / 86400), F.ceil(-seconds / 86400)

    def text(n: Column, label: str) -> Column:
        return F.concat(n.cast("string"), F.lit(LABELS[label]))

    return (
        F.when(at.isNull(), LABELS["none"])
        .when((days < 0) & (ahead == 1), LABELS["tomorrow"])
        .when(days < 0, text(ahead, "ahead"))
        .when(days == 0, LABELS["today"])
        .when(days == 1, LABELS["yesterday"])
        .when(days < 30, text(days, "days"))
        .when(days < 365, text(F.floor(days / 30), "months"))
        .otherwise(text(F.floor(days / 365), "years"))
    )


def whole_days(at: Column, as_of: str) -> Column:
    return F.floor(age_days(at, as_of)).cast("long")
