"""Exported chats in files: JSON of any shape, CSV with any headers, and text lines.

A file is one row and is parsed whole in one task, as an export is a document and not a table; its messages then are rows
like any others. Names of fields are looked up without case, spaces, dashes and underscores."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions.columns import DATE_TIME, blank_as_null, captured_at, fnv1a36, trimmed

# Field names, words and patterns that results depend on.
CONTENT = "content text message msg body messagecontent msgcontent".split()
TIME = "timestamp time datetime date formattedtime createtime sendtime msgtime".split()
SPEAKER = "sender sendername senderdisplayname from nickname author username talker".split()
NESTED_NAME = "displayname senderdisplayname nickname remark remarkname name username".split()
TYPE = "type msgtype messagetype".split()
SELF_FLAG = "issend issendmsg issendmessage issendbyme isoutgoing isself isfromme fromme fromself outgoing self".split()
DIRECTION = "direction msgdirection messagedirection senderrole".split()
SELF_ID = "selfuin myuin selfid myid myaccountid".split()
SENDER_ID = "senderuin senderid fromuin fromid authorid senderaccountid".split()
AVATAR = (
    "avatar avatarurl headimg headimgurl headurl head headimage headimageurl smallhead smallheadurl bighead bigheadurl face faceurl icon iconurl profileimage profileimageurl portrait"
).split()
AVATAR_URL = r"(?i)^(?:https?://|data:image/)"
SELF_WORDS, OTHER_WORDS = "self me out outgoing send sent".split(), "other in incoming receive received".split()
SELF_TYPES, OTHER_TYPES = "发送 已发送 发出 本人".split(), "接收 收到 对方".split()
SOURCES = (
    (r"chatgpt|openai|deepseek|gemini|claude|ai[-_ ]?chat", "AI 对话导入"),
    ("朋友圈|moments|friendcircle", "朋友圈导出"),
    ("微信|wechat|weixin", "微信导出"),
    ("qq", "QQ 导出"),
    ("校园|campus|school", "校园平台"),
)
OTHER_SOURCE = "本地文件"
GROUP_FOLDER, DIRECT_FOLDER = r"(?i)群聊|群组|群消息|group|groups|chatroom", r"(?i)私聊|单聊|好友|friend|direct|personal"
AI_FOLDER = r"(?i)^(?:ai|ai[-_ ]?chat|对话ai)$"

PARSED = "source_file string, ord long, text string, at string, speaker string, avatar_url string, message_type string, speaker_role string"


def _key(name: str) -> str:
    return re.sub(r"[_\s-]", "", name.lower())


def _readable(value) -> str:
    return re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else ""


def role_of(value, key: str) -> str:
    """self, other or unknown, from a field that may tell the direction."""
    word = str(value).strip().lower() if value is not None else ""
    if key in SELF_FLAG:
        if value is True or value == 1 or word in ["true", "1", "yes", *SELF_WORDS]:
            return "self"
        if value is False or (value == 0 and value is not None) or word in ["false", "0", "no", *OTHER_WORDS]:
            return "other"
    if key in DIRECTION or key == "type":
        if word in SELF_WORDS + (SELF_TYPES if key == "type" else []):
            return "self"
        if word in OTHER_WORDS + (OTHER_TYPES if key == "type" else []):
            return "other"
    return "unknown"


class _Fields:
    """An object's fields by their plain keys, in their order."""

    def __init__(self, fields: dict):
        self.pairs = [(_key(k), v) for k, v in fields.items()]

    def first(self, names: list[str], read):
        return next((x for k, v in self.pairs if k in names and (x := read(v))), None)

    def role(self) -> str:
        told = next((r for k, v in self.pairs if (r := role_of(v, k)) != "unknown"), "unknown")
        me, sender = (self.first(n, lambda v: str(v).strip().lower() if v is not None else "") for n in (SELF_ID, SENDER_ID))
        return told if told != "unknown" or not (me and sender) else "self" if me == sender else "other"

    def speaker(self) -> str | None:
        return self.first(SPEAKER, _readable) or self.first(SPEAKER, _nested_name)


def _nested_name(value, depth: int = 0) -> str:
    if not isinstance(value, dict) or depth > 3:
        return ""
    return _Fields(value).first(NESTED_NAME, _readable) or next((n for v in value.values() if (n := _nested_name(v, depth + 1))), "")


def _avatar(value, depth: int = 0) -> str:
    if isinstance(value, str):
        return value if len(value) <= 4000 and re.match(AVATAR_URL, value) else ""
    if not isinstance(value, dict) or depth > 3:
        return ""
    return next((u for k, v in value.items() if _key(k) in ("url", "uri", "src", "href") and (u := _avatar(v, 9))), "") or next((u for v in value.values() if isinstance(v, dict) and (u := _avatar(v, depth + 1))), "")


def _time(value) -> str:
    if isinstance(value, bool) or value is None:
        return ""
    return str(int(value)) if isinstance(value, (int, float)) and value == value else value.strip() if isinstance(value, str) else ""


def json_messages(document, strict: bool) -> list[dict]:
    """The messages of a document: objects with content, which take from what is around them what they do not say."""
    found, stack = [], [(document, {"speaker_role": "unknown"})]
    while stack:
        value, around = stack.pop()
        if isinstance(value, list):
            stack += [(x, around) for x in reversed(value)]
            continue
        if not isinstance(value, dict):
            continue
        fields = _Fields(value)
        role = fields.role()
        own = {
            "at": fields.first(TIME, _time),
            "speaker": fields.speaker(),
            "avatar_url": fields.first(AVATAR, _avatar),
            "message_type": (fields.first(TYPE, lambda v: str(v).strip() if v is not None else "") or "")[:80] or None,
            "speaker_role": role if role != "unknown" else None,
        }
        now = around | {k: v for k, v in own.items() if v}
        text = fields.first(CONTENT, _readable) or ""
        if len(text) >= 2 and (not strict or now.get("at") or now.get("speaker") or now["speaker_role"] != "unknown"):
            found.append(now | {"text": text})
        else:
            stack += [(x, now) for x in reversed(list(value.values()))]
    return found


def json_lines(document, prefix: str = "") -> Iterator[str]:
    """Every leaf as `path: value`."""
    if isinstance(document, dict):
        for k, v in document.items():
            yield from json_lines(v, f"{prefix}{k}: ")
    elif isinstance(document, list):
        for i, v in enumerate(document):
            yield from json_lines(v, f"{prefix}[{i}] ")
    elif document is not None:
        yield f"{prefix}{json.dumps(document) if isinstance(document, bool) else document}"


def csv_messages(text: str) -> list[dict] | None:
    """The messages of a table with a content column; None if it has none."""
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    heads = [_key(h) for h in rows[0]] if rows else []

    def place(names):
        return next((i for i, h in enumerate(heads) if h in names), None)

    content, at, speaker, kind, role = (place(n) for n in (CONTENT, TIME, SPEAKER, TYPE, SELF_FLAG + DIRECTION))
    if len(rows) < 2 or content is None:
        return None

    def cell(row, i):
        return row[i] if i is not None and i < len(row) else ""

    out = [{"text": _readable(cell(r, content)), "at": cell(r, at).strip(), "speaker": _readable(cell(r, speaker)), "message_type": cell(r, kind).strip()[:80], "speaker_role": role_of(cell(r, role), heads[role]) if role is not None else "unknown"} for r in rows[1:]]
    return [x for x in out if len(x["text"]) >= 2]


def _frame(path: str, messages: list[dict]) -> pd.DataFrame:
    names = ["text", "at", "speaker", "avatar_url", "message_type", "speaker_role"]
    return pd.DataFrame([(path, i, *[m.get(n) or None for n in names]) for i, m in enumerate(messages)], columns=["source_file", "ord", *names])


def read_documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """source_file, value: each file whole."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")


def read_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """PARSED rows of JSON files; one without messages gives its leaves as lines, unless strict."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, value in zip(batch["source_file"], batch["value"], strict=True):
                try:
                    document = json.loads(value)
                except ValueError:
                    continue
                found = json_messages(document, strict)
                if not found and not strict:
                    found = [{"text": x, "speaker_role": "unknown"} for x in json_lines(document) if len(x) >= 8]
                yield _frame(file, found)

    return read_documents(spark, path, "*.json").mapInPandas(parse, PARSED)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """PARSED rows of CSV files; one without a content column is read as text lines."""
    files = read_documents(spark, path, "*.csv")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, value in zip(batch["source_file"], batch["value"], strict=True):
                found = csv_messages(value)
                yield _frame(file, [{"text": None, "at": value}] if found is None else found)

    parsed = files.mapInPandas(parse, PARSED)
    lines = text_messages(parsed.where("text IS NULL").select("source_file", F.col("at").alias("value")))
    return parsed.where("text IS NOT NULL").unionByName(lines)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """PARSED rows of text files."""
    return text_messages(read_documents(spark, path, "*.txt"))


def text_messages(files: DataFrame) -> DataFrame:
    """Lines `[time] speaker: text`, of which only the text must be there. A time counts until the next one."""
    lines = files.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("line", trimmed("line")).where("line <> ''")
    head = rf"^(?:\[\s*)?({re.sub(r'\((?![?])', '(?:', DATE_TIME)})(?:\s*\])?\s*"
    timed = F.regexp_extract("line", head, 1)
    at = captured_at(blank_as_null(timed))
    rest = trimmed(F.regexp_replace(F.regexp_replace("line", head, ""), r"^[-|：:]+\s*", ""))
    rows = lines.withColumn("stamped", timed != "").withColumn("own_at", at).withColumn("rest", F.when(timed != "", rest).otherwise(F.col("line")))
    named = F.col("stamped") & F.col("rest").rlike(r"^[^：:]{1,48}[：:]\s*.+$")
    rows = rows.withColumn("speaker", F.when(named, trimmed(F.regexp_extract("rest", r"^([^：:]{1,48})[：:]", 1)))).withColumn("text", F.when(named, trimmed(F.regexp_extract("rest", r"^[^：:]{1,48}[：:]\s*(.+)$", 1))).otherwise(F.col("rest")))
    so_far = Window.partitionBy("source_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.last("own_at", ignorenulls=True).over(so_far)).where(F.length("text") >= 2)
    none = F.lit(None).cast("string")
    return rows.select("source_file", F.col("pos").cast("long").alias("ord"), "text", "at", "speaker", none.alias("avatar_url"), none.alias("message_type"), F.lit("unknown").alias("speaker_role"))


def source_of(path: str) -> Column:
    """The platform that a file's name and folders tell."""
    low, out = F.lower(F.col(path)), None
    for pattern, name in SOURCES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(OTHER_SOURCE)


def conversation_of(path: str) -> Column:
    """id, name and kind of the conversation a file belongs to, from its path: the folder below a folder for group or direct
    chats (or two below one for AI chats), else a file name that begins so, else the whole folder."""
    parts = F.filter(F.split(F.regexp_replace(F.col(path), r"\\", "/"), "/"), lambda p: p != "")
    folders, stem = F.slice(parts, 1, F.size(parts) - 1), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")

    def index(pattern):
        return F.array_position(F.transform(folders, lambda f: f.rlike(pattern)), True)

    group, direct, ai = index(GROUP_FOLDER), index(DIRECT_FOLDER), index(AI_FOLDER)
    category = F.when(group > 0, group).otherwise(direct)
    named_group, named_direct = stem.rlike(rf"^(?:{GROUP_FOLDER})".replace("(?:(?i)", "(?i)(?:")), stem.rlike(rf"^(?:{DIRECT_FOLDER})".replace("(?:(?i)", "(?i)(?:"))
    below = (category > 0) & (F.size(folders) > category)
    own_file = named_group | named_direct | ((category > 0) & (F.size(folders) <= category))
    deep = (category > 0) & (ai == category + 1) & (F.size(folders) >= ai + 2)
    kept = F.when(deep, F.slice(folders, F.lit(1), (ai + 2).cast("int"))).when(below, F.slice(folders, F.lit(1), (category + 1).cast("int"))).otherwise(folders)
    joined = F.array_join(kept, "/")
    name = F.when(own_file, stem).otherwise(F.coalesce(F.try_element_at(kept, F.lit(-1)), stem))
    place = F.when(own_file, F.array_join(F.concat(folders, F.array(stem)), "/")).otherwise(F.when(joined == "", stem).otherwise(joined))
    kind = F.when(group > 0, "group").when(direct > 0, "direct").when(named_group, "group").when(named_direct, "direct").otherwise("unknown")
    return F.struct(F.concat(F.lit("folder:"), place).alias("conversation_id"), name.alias("conversation_name"), kind.alias("conversation_kind"))


def messages(parsed: DataFrame, root: str = "") -> DataFrame:
    """Archive messages of PARSED rows; a speaker's first avatar in a file stands for those without one."""
    first = F.first("avatar_url", ignorenulls=True).over(Window.partitionBy("source_file", "speaker").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = parsed.withColumn("path", F.regexp_replace("source_file", rf"^(?:file:/*)?/?{re.escape(root.strip('/'))}/?" if root else r"^(?:file:)?/*", ""))
    rows = rows.withColumn("avatar_url", F.coalesce("avatar_url", first)).withColumn("place", conversation_of("path")).withColumn("iso_at", captured_at(F.col("at")))
    at = F.col("iso_at")
    said = F.concat_ws(": ", "speaker", "text")
    summary = F.substring(said, 1, 1200)
    return rows.select(
        F.concat(F.lit("intel-"), fnv1a36(F.concat_ws("|", "path", F.col("ord").cast("string"), "text"))).alias("id"),
        source_of("path").alias("source"),
        F.col("path").alias("source_file"),
        "place.conversation_id",
        "place.conversation_name",
        "place.conversation_kind",
        "speaker",
        F.coalesce("speaker_role", F.lit("unknown")).alias("speaker_role"),
        "message_type",
        F.col("text").alias("content"),
        summary.alias("summary"),
        "avatar_url",
        at.alias("captured_at"),
        F.to_timestamp_ntz(F.when(F.length(at) == 10, F.concat(at, F.lit("T00:00:00"))).otherwise(at)).alias("captured_ts"),
        F.lit("new").alias("status"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, signature of the files below a folder; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string")).alias("signature"))


def planned(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: what is added, changed or removed between two manifests."""
    both = old.withColumnRenamed("signature", "was").join(new.withColumnRenamed("signature", "now"), "path", "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
