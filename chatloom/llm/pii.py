"""Personal data: checked patterns, and further spans that weak labelers agree on.

Base spans are the leftmost non-overlapping matches of one pattern a kind that pass the kind's check (parts of an
address, digits of a number, Luhn's sum); a match that fails is dropped and not retried. They always stay.

Method, in DataFrame operations only. Candidates are the base spans, the matches that failed their check, and matches of
looser patterns (spelled-out addresses, numbers without a country code, bank account numbers, long keys). Three labelers
vote on each: its format (checksums, ranges, alphabets), a gazetteer (domain endings, calling codes, card issuers, address
ranges, the lengths of account numbers by country, words that name keys and prefixes that keys begin with) and the text
just before it. Expectation-maximisation over the counts of vote patterns, a table whose size depends on the labelers alone,
estimates how reliable each labeler is for each kind and how likely each pattern is right. With those likelihoods as soft
labels a naive Bayes span classifier is fitted on what the candidate and its surroundings look like; candidates that are
no base spans are added if it finds them likely enough and they touch no base span of their kind.

Every quantity is counted over all candidates of all documents. Nothing is shuffled but these counts. Patterns are
possessive, so that a long run of characters makes matching neither quadratic nor deep; the places of n matches are running
sums by doubling, and a base span that touches a candidate is found by halving, so a text of n matches takes n log n steps.

Defined results: a null text is empty and has no spans; rows without a doc_id or with a repeated one each get a result;
without candidates nothing is added; columns other than doc_id and text are ignored. Offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "secret")

# The patterns of the base kinds, with possessive repeats where what follows can never need a shorter one.
# A match may begin where a run of its first characters begins or where the last match ended. A card's run of digits is
# never parted, so runs that are too short by far to pass are not matched at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
#: A text without a match of it has no match of the pattern: it is a part of each.
NEEDS = {("email", True): "@", ("phone", True): r"\+", ("email", False): r"(?i)[(\[]at[)\]]", ("iban", False): "[A-Z]{2}[0-9]{2}"}

# Gazetteers.
GENERIC_ENDINGS = (
    "com|org|net|edu|gov|mil|int|arpa|info|biz|name|pro|app|dev|cloud|online|site|shop|store|tech|xyz|club|live|blog|email|mobi|travel|jobs|coop|aero|museum|post|cat|"
    "page|wiki|news|media|group|team|work|world|today|agency|studio|design|digital|network|systems|solutions|services|support|academy|education|school|health|bank|finance"
)
COUNTRY_ENDINGS = "[a-z]{2}"
CALLING = (
    "1|7|20|27|21[1-3689]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[01789]|3[0-469]|35[0-9]|37[0-8]|38[0-35-79]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|"
    "6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|80[08]|8[1246]|85[02356]|87[08]|88[0268]|9[0-58]|96[0-8]|97[0-79]|99[2-68]"
)
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|62|352[89]|35[3-8]|5018|5020|5038|6304|67"
RESERVED = r"(?:0|127|22[4-9]|2[3-5][0-9])\.|169\.254\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\."
KEY_WORDS = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|signing[_-]?key|auth|bearer|credential|session[_-]?id|cookie|webhook"
KEY_PREFIXES = "AKIA|ASIA|AIza|ya29|eyJ|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[rs]k_(?:live|test)_|npm_|pypi-|SG[.]|dop_v1_"
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
CUES = {
    "email": "mail|contact|write|send|address",
    "ip": r"\bip\b|host|server|address|from|client",
    "card": "card|visa|master|credit|pay|account",
    "phone": "phone|tel|call|mobile|fax|dial|contact",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer|pay",
    "secret": KEY_WORDS,
}
AGAINST = {
    "email": r"https?://\S*$",
    "ip": r"\bv(?:er(?:sion)?)?\.? ?$|§ ?$|section ?$",
    "card": r"isbn|order|\bno\.? ?$|[$€£] ?$",
    "phone": r"[$€£] ?$|isbn|[=<>*/] ?$",
    "iban": r"https?://\S*$|order|isbn|serial",
    "secret": r"https?://\S*$|sha\d* ?$|commit|digest|etag|checksum",
}
#: Characters of the text before and after a candidate that labelers and features look at.
BEFORE, AFTER = 24, 2
VOTES = ("form", "listed", "context")


def _two_to(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bit)


def _running(values: str) -> Column:
    """For the array column of that name, the sum before each element. After each round an element has the sum of twice as many."""
    before = F.transform(values, lambda _, i: F.coalesce(F.get(F.col(values), i - 1), F.lit(0)))
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int"))

    def add(sums, bit):
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - _two_to(bit)), F.lit(0)))

    return F.when(F.size(values) > 1, F.aggregate(rounds, before, add)).otherwise(before)


def _touches(x: Column, spans: str) -> Column:
    """Whether x has a part in common with one of the spans, which are in order and apart: of those that begin before x ends, the last is found by halving."""

    def later(at, bit):
        there = at + _two_to(bit)
        return F.when(F.get(F.col(spans), there)["start"] < x["end"], there).otherwise(at)

    last = F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), F.lit(-1), later)
    return F.coalesce(F.get(F.col(spans), last)["end"] > x["start"], F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _account(match: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its letters being 10 to 35 and its first four places the last."""
    plain = F.regexp_replace(match, " ", "")
    places = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest, i):
        code = F.ascii(F.substring(places, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), add) == 1


def _passes(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(F.when(F.length(digits).between(16, 19), _luhn(digits)), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _listed(kind: str, match: Column, before: Column) -> Column:
    """1, 0 or -1: what the gazetteer says."""
    if kind == "email":
        return F.when(F.lower(match).rlike(rf"(?:\.|dot[)\]]) ?(?:{GENERIC_ENDINGS}|{COUNTRY_ENDINGS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(match.rlike(rf"^0*(?:{RESERVED})"), -1).otherwise(1)
    if kind == "card":
        return F.when(match.rlike(f"^(?:{ISSUERS})"), 1).otherwise(0)
    if kind == "phone":
        return F.when(match.rlike(rf"^\+(?:{CALLING})"), 1).when(match.startswith("+"), -1).otherwise(0)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        known = F.lit(False)
        for length, countries in ACCOUNT_LENGTHS.items():
            known = known | ((F.length(plain) == length) & plain.rlike(f"^(?:{countries})"))
        return F.when(known, 1).otherwise(-1)
    return F.when(F.lower(before).rlike(rf"(?:{KEY_WORDS})\W*$") | match.rlike(f"^(?:{KEY_PREFIXES})"), 1).otherwise(0)


def _context(kind: str, before: Column) -> Column:
    near = F.lower(before)
    return F.when(near.rlike(AGAINST[kind]), -1).when(near.rlike(f"(?:{CUES[kind]})"), 1).otherwise(0)


def _form(kind: str, match: Column, strict: bool) -> Column:
    if strict:
        return F.when(_passes(kind, match), 1).otherwise(-1)
    if kind == "iban":
        return F.when(_account(match), 1).otherwise(-1)
    if kind == "secret":
        return F.when(match.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & match.rlike("[0-9]") & match.rlike("[A-Fa-f]"), 1).when(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), 0).otherwise(-1)
    return F.lit(0)


def _side(text: Column) -> Column:
    """The class of the last character."""
    last = F.right(text, F.lit(1))
    return F.when(F.length(text) == 0, "none").when(last.rlike(r"\s"), "space").when(last.rlike("[A-Za-z0-9]"), "word").when(last.rlike("[\"'`]"), "quote").when(last.rlike("[-.:=_/]"), "join").otherwise("other")


def _features(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """Of a few values each."""
    return [
        F.concat(F.lit("length:"), F.least(F.lit(10), (F.length(match) / 4).cast("int")).cast("string")),
        F.concat(F.lit("digits:"), (F.length(_digits(match)) * 4 / F.length(match)).cast("int").cast("string")),
        F.concat(F.lit("left:"), _side(before)),
        F.concat(F.lit("right:"), _side(F.reverse(after))),
        F.concat(F.lit("cue:"), F.lower(before).rlike(f"(?:{CUES[kind]})").cast("string")),
        F.concat(F.lit("joint:"), match.rlike("[ ()]").cast("string")),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, for every row, spans: kind, start, end, base, votes and features, in the order of kinds and starts."""
    scans = [(kind, True, PATTERNS[kind]) for kind in KINDS] + [(kind, False, LOOSE[kind]) for kind in LOOSE]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.col("text").rlike("[0-9]").alias("numbered"))
    found = []
    for i, (kind, strict, pattern) in enumerate(scans):
        may = F.col("text").rlike(NEEDS[kind, strict]) if (kind, strict) in NEEDS else F.col("numbered")
        found += [F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m{i}"), F.when(may, F.split("text", pattern, -1)).alias(f"g{i}")]
    rows = rows.select("doc_id", *found)

    def steps(i):
        """The lengths of a match and the gap before it."""
        return F.transform(F.coalesce(F.col(f"m{i}"), F.array().cast("array<string>")), lambda m, k: F.length(F.get(F.col(f"g{i}"), k)) + F.length(m))

    rows = rows.select("*", *[steps(i).alias(f"s{i}") for i in range(len(scans))])
    rows = rows.select("*", *[_running(f"s{i}").alias(f"p{i}") for i in range(len(scans))])

    def spans(i, kind, strict):
        def span(at, k):
            match, gap = F.get(F.col(f"m{i}"), k), F.get(F.col(f"g{i}"), k)
            before, after = F.right(gap, F.lit(BEFORE)), F.left(F.get(F.col(f"g{i}"), k + 1), F.lit(AFTER))
            start = at + F.length(gap)
            return F.struct(
                F.lit(kind).alias("kind"),
                start.cast("long").alias("start"),
                (start + F.length(match)).cast("long").alias("end"),
                (_passes(kind, match) if strict else F.lit(False)).alias("base"),
                _form(kind, match, strict).alias("form"),
                _listed(kind, match, before).alias("listed"),
                _context(kind, before).alias("context"),
                F.array(*_features(kind, match, before, after)).alias("features"),
            )

        return F.transform(f"p{i}", span)

    return rows.select("doc_id", F.concat(*[spans(i, kind, strict) for i, (kind, strict, _) in enumerate(scans)]).alias("spans"))


# Weak supervision ----------------------------------------------------------------------------------------------------


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30, prior: float = 0.5) -> dict[tuple[str, tuple[int, ...]], float]:
    """The likelihood that a candidate is right, by kind and votes, from (kind, votes, how many)."""
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        # the majority begins
        right = {v: 1 / (1 + math.exp(-2 * sum(v))) for v, _ in own}
        for _ in range(rounds):
            total = sum(n for _, n in own)
            good = sum(n * right[v] for v, n in own)
            share = (good + prior) / (total + 2 * prior)
            chance: list[dict[int, tuple[float, float]]] = []
            for j in range(len(own[0][0])):
                chance.append({})
                for vote in (-1, 0, 1):
                    yes = sum(n * right[v] for v, n in own if v[j] == vote)
                    no = sum(n * (1 - right[v]) for v, n in own if v[j] == vote)
                    # a labeler is taken to be rather right than wrong
                    chance[j][vote] = ((yes + 1 + prior * (vote > 0)) / (good + 3.5), (no + 1 + prior * (vote < 0)) / (total - good + 3.5))
            right = {v: 1 / (1 + math.exp(min(50.0, max(-50.0, -math.log(share / (1 - share)) - sum(math.log(chance[j][x][0] / chance[j][x][1]) for j, x in enumerate(v)))))) for v, _ in own}
        out |= {(kind, v): right[v] for v, _ in own}
    return out


def _weight(table: dict[tuple[str, str], float], kind: Column, value: Column) -> Column:
    """table[kind, value], 0 for what it does not have."""
    if not table:
        return F.lit(0.0)
    held = F.create_map(*[F.lit(x) for (k, v), w in sorted(table.items()) for x in (f"{k} {v}", float(w))])
    return F.coalesce(F.try_element_at(held, F.concat(kind, F.lit(" "), value)), F.lit(0.0))


def classifier(spans: DataFrame) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """By kind the log odds, and by kind and feature what it adds to them. spans: kind, votes and features of every candidate."""
    counts = spans.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()  # 27 rows a kind at most
    right = reliabilities([(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in counts])
    likely = {(k, " ".join(map(str, v))): p for (k, v), p in right.items()}
    soft = _weight(likely, F.col("kind"), F.concat_ws(" ", *VOTES))
    sums = spans.select("kind", soft.alias("right"), F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("right").alias("yes"), F.count("*").alias("n")).collect()  # some thirty rows a kind at most
    good, total = {}, {}
    for r in sums:
        if r["feature"].startswith("joint:"):
            good[r["kind"]] = good.get(r["kind"], 0.0) + r["yes"]
            total[r["kind"]] = total.get(r["kind"], 0) + r["n"]
    odds = {k: math.log((good[k] + 0.5) / (total[k] - good[k] + 0.5)) for k in total}
    weights = {}
    for r in sums:
        k = r["kind"]
        weights[k, r["feature"]] = math.log((r["yes"] + 0.5) / (good[k] + 3)) - math.log((r["n"] - r["yes"] + 0.5) / (total[k] - good[k] + 3))
    return odds, weights


def personal_data(docs: DataFrame, sure: float = 0.9) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end in the order of kinds and starts) for every row of docs."""
    found = staged(candidates(docs), "pii_candidates")
    spans = found.select(F.explode_outer("spans").alias("span")).where("span IS NOT NULL").select("span.kind", *[f"span.{v}" for v in VOTES], "span.features")
    odds, weights = classifier(spans)
    least = math.log(sure / (1 - sure))
    start = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, v)]) if odds else None

    def likely(x: Column) -> Column:
        if start is None:
            return F.lit(False)
        return F.aggregate(x["features"], F.coalesce(F.try_element_at(start, x["kind"]), F.lit(0.0)), lambda a, f: a + _weight(weights, x["kind"], f)) >= least

    def plain(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    both = [k for k in LOOSE if k in KINDS]
    rows = found.select("doc_id", F.filter("spans", lambda x: x["base"]).alias("sure"), F.filter("spans", lambda x: ~x["base"] & (x["form"] >= 0)).alias("maybe"))
    rows = rows.select("doc_id", "sure", F.filter("maybe", likely).alias("maybe"), *[of_kind(F.col("sure"), k).alias(f"sure_{k}") for k in both])

    def apart(x: Column) -> Column:
        touches = F.lit(False)
        for k in both:
            touches = F.when(x["kind"] == k, _touches(x, f"sure_{k}")).otherwise(touches)
        return ~touches

    return rows.select("doc_id", F.transform("sure", plain).alias("base"), F.transform(F.filter("maybe", apart), plain).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_kind(base: str, added: str) -> Column:
    """All spans, by kind as listed, then start."""
    every = F.concat(F.col(base), F.col(added))
    return F.concat(*[F.array_sort(of_kind(every, k)) for k in (*KINDS, *ADDED_KINDS)])


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)
