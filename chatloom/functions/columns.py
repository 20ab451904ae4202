"""Column expressions that the operators share. All of them stay in the JVM but `nfkc`."""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

if TYPE_CHECKING:
    from pyspark.sql._typing import ColumnOrName

# Words and patterns that results depend on.
GROUP_WORDS = r"(?i)群聊|群组|群消息|group|groups|chatroom"
DIRECT_WORDS = r"(?i)私聊|单聊|好友|friend|direct|personal"
DATE_TIME = r"(\d{4})\s*(?:年|[-/])\s*(\d{1,2})\s*(?:月|[-/])\s*(\d{1,2})(?:\s*(?:日|号))?(?:[ T]+(\d{1,2})(?:\s*[:时]\s*(\d{1,2}))?(?:\s*[:分]\s*(\d{1,2}))?\s*秒?\s*)?"
#: Ages in days and how relevant a message of at most that age is.
RELEVANCE = ((3, 1.0), (7, 0.92), (14, 0.78), (30, 0.62), (60, 0.42), (120, 0.24), (365, 0.1))
RELEVANCE_OLDER, RELEVANCE_UNDATED = 0.04, 0.08
#: What counts as white space.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Punctuation, symbols and WHITE, said by what they are not, so that a letter is told by the first class that is asked.
UNLETTERED = r"[^\p{L}\p{M}\p{N}[\p{C}&&[^\t-\r\x{feff}]]]+"


@cache
def _compatibility() -> tuple[str, str, str]:
    """By Unicode's compatibility composition: characters that become one other whatever stands beside them, what they become,
    and the others of the basic plane that it may change, alone or with what is before them."""
    one, more = {}, []
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        x = chr(c)
        to = unicodedata.normalize("NFKC", x)
        if unicodedata.category(x)[0] == "M" or 0x1160 <= c < 0x1200 or (to != x and (len(to) > 1 or unicodedata.category(to)[0] == "M")):
            more.append(x)
        elif to != x:
            one[x] = to
    return "".join(one), "".join(one.values()), "".join(more)


def trimmed(text: ColumnOrName) -> Column:
    """text without white space, of any kind, at its ends."""
    return F.trim(text, F.lit(WHITE))


def blank_as_null(text: Column) -> Column:
    return F.when(trimmed(text) != "", text)


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 units, in which the archive's limits are counted."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def fnv1a36(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-16 units, in base 36."""
    state = F.aggregate(utf16_units(text), F.lit(2166136261), lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(state.cast("string"), 10, 36))


def text_key(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, f"[{WHITE}]+", ""))


def compact_key(text: Column) -> Column:
    """Lower case, in compatibility composition, without punctuation, symbols and white space.

    Characters that compose with nothing are translated; only texts with others (combining marks, ligatures, voiced kana in
    half width, numbers in circles of two digits) go through Python, the others as nulls."""
    plain, to, others = _compatibility()
    ascii_only = F.length(text) == F.octet_length(text)
    composes = (F.length(F.translate(text, others, "")) != F.length(text)) | text.rlike(r"[\x{10000}-\x{10ffff}]")
    composed = F.when(ascii_only, text).otherwise(F.coalesce(nfkc(F.when(~ascii_only & composes, text)), F.translate(text, plain, to)))
    return F.lower(F.regexp_replace(composed, UNLETTERED, ""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark has no function for."""
    return text.str.normalize("NFKC")


def in_locale(name: ColumnOrName, locale: str = "zh_Hans_CHN") -> Column:
    """A name to order by as its language does, not by code points."""
    return F.collate(name, locale)


def field_key(name: Column) -> Column:
    """A field name as synonym lists have it."""
    return F.lower(F.regexp_replace(name, r"[_\s-]", ""))


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def conversation_key(conversation_id: str = "conversation_id", source: str = "source", at: str = "captured_ts") -> Column:
    """The conversation a message belongs to; without an id, its source and month."""
    legacy = F.concat(F.lit("legacy:"), F.coalesce(blank_as_null(trimmed(F.col(source))), F.lit("unknown")), F.lit(":"), F.coalesce(month_of(F.col(at)), F.lit("undated")))
    return F.coalesce(blank_as_null(F.col(conversation_id)), legacy)


def conversation_kind(kind: str = "conversation_kind", name: str = "conversation_name", conversation_id: str = "conversation_id") -> Column:
    """The kind that is given, else the one that the name and id tell."""
    label = F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("/"), F.coalesce(F.col(conversation_id), F.lit("")))
    return F.when(F.col(kind).isNotNull() & (F.col(kind) != "unknown"), F.col(kind)).when(label.rlike(GROUP_WORDS), "group").when(label.rlike(DIRECT_WORDS), "direct").otherwise("unknown")


def age_days(at: Column, as_of: str) -> Column:
    """Days, with fractions, from a time without zone to as_of; never negative."""
    seconds = F.unix_timestamp(F.to_timestamp_ltz(F.lit(as_of))) - F.unix_timestamp(at.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / 86400)


def relevance(at: Column, as_of: str) -> Column:
    """How relevant a message is by its age."""
    age = age_days(at, as_of)
    steps = F.when(at.isNull(), RELEVANCE_UNDATED)
    for days, value in RELEVANCE:
        steps = steps.when(age <= days, value)
    return steps.otherwise(RELEVANCE_OLDER)


def row_size(at: str = "captured_ts", content: str = "content", role: str = "speaker_role", limit: int = 3000) -> Column:
    """The size of the compact row [0, time, content, role] as JSON: 64 at least, and 8 for what is around it."""
    text = F.coalesce(blank_as_null(F.substring(trimmed(F.col(content)), 1, limit)), F.lit("[non-text message]"))
    # an object of one field of the same value has {"v":...}, six characters more
    quoted = utf16_length(F.to_json(F.struct(text.alias("v")))) - 6
    time = F.coalesce(F.length(F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss")) + 2, F.lit(4))
    whole = F.lit(2) + 1 + 3 + time + quoted + F.length(F.coalesce(F.col(role), F.lit("unknown"))) + 2
    return F.greatest(F.lit(64), whole + 8)


def captured_at(value: Column) -> Column:
    """An exported time as ISO text: epoch seconds or milliseconds, or a date with an optional time; midnight gives the
    date alone, a date that is none gives null. Zones are not looked at."""
    return _once(trimmed(F.regexp_replace(value, "　", " ")), _captured_at)


def _once(value: Column, made) -> Column:
    """made of the value, which is worked out once, however often made looks at it."""
    return F.get(F.transform(F.array(value), made), 0)


def _captured_at(text: Column) -> Column:
    number = F.when(text.rlike(r"^\d{10,13}$"), text.cast("long"))
    epoch = F.timestamp_millis(F.when(number < 100_000_000_000, number * 1000).otherwise(number))
    found = F.regexp_replace(F.regexp_extract(text, DATE_TIME, 0), DATE_TIME, "$1,$2,$3,$4,$5,$6")
    numbers = F.transform(F.split(found, ","), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))

    def time_of(n: Column) -> Column:
        part = [F.coalesce(F.get(n, i), F.lit(0)) for i in range(6)]
        return F.when((part[5] < 60) & (part[3] < 24), F.try_make_timestamp_ntz(*part[:5], part[5].cast("decimal(8,6)")))

    def written(made: Column) -> Column:
        return F.when(F.date_format(made, "HHmmss") == "000000", F.date_format(made, "yyyy-MM-dd")).otherwise(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss"))

    other = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss")
    dated = F.when(text.rlike(DATE_TIME), _once(_once(numbers, time_of), written)).otherwise(other)
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(number.isNotNull(), F.date_format(epoch, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(dated)


def local_time(value: Column, end_of_day: bool = False) -> Column:
    """A time, of which a date alone means its first or its last second."""
    dated = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.to_timestamp_ntz(F.when(dated, F.concat(value, F.lit("T23:59:59" if end_of_day else "T00:00:00"))).otherwise(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss")))


def union_of(*arrays: Column, most: int) -> Column:
    """Trimmed, not blank, distinct in their first order, `most` at most."""
    every = F.filter(F.transform(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda x: trimmed(x)), lambda x: x != "")
    return F.slice(F.array_distinct(every), 1, most)


def cursor_of(*parts: Column) -> Column:
    """A page's cursor: its keys as URL-safe base64 of JSON."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.array(*parts)).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def char_grams(*texts: Column, sizes: tuple[int, ...] = (3, 2), most: int = 36) -> Column:
    """Distinct runs of letters and digits in the texts without white space, of the larger size first for each text."""

    def runs(letters: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(letters) - (n - 1))
        return F.when(F.size(letters) >= n, F.transform(at, lambda i: F.concat(*[F.element_at(letters, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    # letters are a lambda's variable, so a text is cleaned and split once and not again for every run
    split = F.transform(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), lambda t: F.split(text_key(t), ""))
    every = F.flatten(F.transform(split, lambda letters: F.concat(*[runs(letters, n) for n in sizes])))
    return F.slice(F.array_distinct(F.filter(every, lambda g: g.rlike(r"^[\u4e00-\u9fffA-Za-z0-9]+$"))), 1, most)
