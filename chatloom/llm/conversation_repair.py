"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the grammar (s?(ua)+)?.

Of each row Keep costs 0, Rerole to user or assistant 1, Delete 2; Insert of an empty user or assistant turn costs 5 and
may stand anywhere. Blank and duplicate rows have to go, and a truncated row that stays adds 5. The audit is the edits'
initials in order; of the cheapest ones the least by ASCII.

Method: cost layers as in bit-parallel approximate matching. The grammar has four states (nothing, after s, after u,
after a; the first and the last accept), so the states from which the rest of the rows can be accepted at a given cost
are four bits, and all layers of a row are one integer, on which each edit is a few shifts. From any two states the least
costs of the rest differ by at most 12 (a rest that suits one is made to suit the other by at most two inserts and one
deletion), so 13 layers above a row's first are all that is ever needed. Rows are taken from the last to the first; the
first layer that holds the start state is the cost, and following bits forward, the least letter first, gives the audit.

A conversation of up to `block` rows is done in one go with its texts. Longer ones, however long, are numbered by sorted
ranges and cut in blocks: each block alone tells its least cost from every state to every state; these 4 x 4 tables are
gone through from the last block to the first, one short row each, then each block is traced from each state, and one
more walk finds which trace holds. Where texts are the same is found by grouping their hashes. What such a conversation
costs one task in the end is the digest of its text, which is streamed in joined pieces: SHA-256 has no parallel form.

Defined results: rows come in the order of turn (nulls first), then role and text, so ties are settled; a null role or
text is one space; a null conv_id is a conversation of its own; a role's first character is its initial, and a role
without one can only be reroled or deleted; texts may be of any length, and blank if empty; repeated rows are duplicates;
no rows give no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.segments import placed

from .common import staged

BLOCK = 4096
#: Rows of a long conversation whose text is joined before it is streamed.
JOINED = 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, CUT, DUPLICATE = 4, 8, 16
ROLES = ("", "system", "user", "assistant")
#: Turns that may follow each other: initials' codes.
LEGAL = {(1, 2), (2, 3), (3, 2)}
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
NUMBERS = pa.list_(pa.int64())

LAYERS = 13
ALL = (1 << (4 * LAYERS)) - 1
ONES = ALL // 15
#: The state that a turn of u or a leads to from each state.
NEXT = (2, 2, 3, 2)


# The layers of one row ----------------------------------------------------------------------------------------------


def _before(layers: int, code: int) -> int:
    """The states from which a turn of that initial leads into the given ones."""
    if code == 1:
        return (layers >> 1) & ONES
    if code == 2:
        into = (layers >> 2) & ONES
        return into | (into << 1) | (into << 3)
    return ((layers >> 3) & ONES) << 2 if code == 3 else 0


def _inserted(layers: int) -> int:
    """With up to two turns inserted."""
    for _ in range(2):
        layers |= (_before(layers, 2) | _before(layers, 3)) << (4 * INSERT)
    return layers


def _row(layers: int, code: int) -> int:
    """The layers before a row from those after it."""
    out = layers << (4 * DELETE)
    if not code & (BLANK | DUPLICATE):
        more = TRUNCATED if code & CUT else 0
        out |= _before(layers, code & 3) << (4 * more)
        out |= (_before(layers, 2) | _before(layers, 3)) << (4 * (more + REROLE))
    return _inserted(out)


def _fallen(layers: int, base: int) -> tuple[int, int]:
    """The same with its first layer at the bottom, and how high that is."""
    if not layers:
        return 0, base
    empty = ((layers & -layers).bit_length() - 1) >> 2
    return (layers >> (4 * empty)) & ALL, base + empty


def of_costs(costs: list[int]) -> tuple[int, int]:
    """Layers of a least cost for each state."""
    base = min(costs)
    return sum(1 << (4 * (c - base) + s) for s, c in enumerate(costs) if c - base < LAYERS), base


def costs_of(layers: int, base: int) -> list[int]:
    """The least cost of each state."""
    out = []
    for s in range(4):
        own = (layers >> s) & ONES
        out.append(base + (((own & -own).bit_length() - 1) >> 2) if own else NEVER)
    return out


#: After the last row: nothing or an answer accepts, the others need turns inserted.
END = (_inserted(0b1001) & ALL, 0)


def layered(codes: list[int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """The layers before each row, and those after the last."""
    out = [end] * (len(codes) + 1)
    layers, base = end
    for i in range(len(codes) - 1, -1, -1):
        layers, base = out[i] = _fallen(_row(layers, codes[i]), base)
    return out


def traced(codes: list[int], at: list[tuple[int, int]], state: int, last: bool) -> tuple[str, str, int]:
    """The least audit of the cheapest edits from a state, the role of each edit (the initial of a new one, else -), and the
    state after them. In the last block turns may be inserted after its last row."""
    i, n, audit, roles = 0, len(codes), [], []
    left = costs_of(*at[0])[state]

    def holds(row: int, s: int, cost: int) -> bool:
        layers, base = at[row]
        return base <= cost < base + LAYERS and bool(layers >> (4 * (cost - base) + s) & 1)

    while i < n or (last and left):
        to = NEXT[state]
        if i < n and holds(i + 1, state, left - DELETE):
            edit, role, i, left = "D", "-", i + 1, left - DELETE
        elif holds(i, to, left - INSERT):
            edit, role, state, left = "I", " sua"[to], to, left - INSERT
        else:
            code = codes[i]
            more = TRUNCATED if code & CUT else 0
            own = {1: 1 if state == 0 else 0, 2: 2 if state != 2 else 0, 3: 3 if state == 2 else 0}.get(code & 3, 0)
            if own and holds(i + 1, own, left - more):
                edit, role, state, left = "K", "-", own, left - more
            else:
                edit, role, state, left = "R", " sua"[to], to, left - more - REROLE
            i += 1
        audit.append(edit)
        roles.append(role)
    return "".join(audit), "".join(roles), state


def _illegal(codes: list[int]) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))


# Rows of Spark ------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations (the same), damaged by the hash of conv_id:turn: a twentieth each of the rows
    goes, loses its text, loses its sentence ends, comes twice, or is the user's. A null is one space there and in texts."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, code (of the initial, blank, truncated) of rows (conv_id, turn, role, text)."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(SPACE))
    initial: Column = F.substring("role", 1, 1)
    of_role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("code", (of_role + fault).cast("int"))


FIELDS = "turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _counts(codes: list[int]) -> list[int]:
    """Rows whose first fault is blank, duplicate, truncated."""
    blank = sum(1 for c in codes if c & BLANK)
    duplicate = sum(1 for c in codes if c & DUPLICATE and not c & BLANK)
    return [blank, duplicate, sum(1 for c in codes if c & CUT and not c & DUPLICATE)]


def _whole(conv, turns: list, roles: list[str], texts: list[str], codes: list[int]) -> tuple:
    seen = set()
    for i, row in enumerate(zip(roles, texts, strict=True)):
        if row in seen:
            codes[i] |= DUPLICATE
        seen.add(row)
    at = layered(codes, END)
    audit, new, _ = traced(codes, at, 0, True)
    lines, i = [], 0
    for edit, role in zip(audit, new, strict=True):
        if edit == "I":
            lines.append(ROLES[" sua".index(role)] + ":")
            continue
        if edit != "D":
            lines.append((roles[i] if edit == "K" else ROLES[" sua".index(role)]) + ":" + texts[i])
        i += 1
    known = {t for t in turns if t is not None}
    return (conv, len(known), min(known, default=None), max(known, default=None), *_counts(codes), _illegal(codes), costs_of(*at[0])[0], audit, "\n".join(lines))


def _short(coded: DataFrame, conv_type: str) -> DataFrame:
    """One row a conversation, of those whose rows fit in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        at, some, done, size = None, False, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(x, pa.int64()) for x in ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired", pa.string())])
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code")), strict=True):
                if some and conv != at:
                    done.append(_whole(at, *held))
                    size += len(done[-1][-1])
                    held = [[], [], [], []]
                    if len(done) >= 2000 or size > 1 << 23:
                        yield out()
                        done, size = [], 0
                at, some = conv, True
                for x, v in zip(held, row, strict=True):
                    x.append(v)
        if some:
            done.append(_whole(at, *held))
            yield out()

    rows = coded.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "code")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {conv_type}, {FIELDS}, repaired string")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the least costs from every state (inner) to every state, and its counts and ends."""
    for batch in batches:
        costs, counts = [], []
        for own in batch.column("codes").to_pylist():
            costs.append([c for to in range(4) for c in costs_of(*layered(own, (1 << to, 0))[0])])
            counts.append([*_counts(own), _illegal(own), own[0] & 3, own[-1] & 3])
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "block": batch.column("block"), "costs": pa.array(costs, NUMBERS), "counts": pa.array(counts, NUMBERS)})


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first: the least costs after each."""
    at, ends = None, []
    for batch in batches:
        out, lasts = [], []
        for who, costs in zip(batch.column("key").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            lasts.append(who != at)
            if who != at:
                at, ends = who, costs_of(*END)
            out.append(ends)
            ends = [min(costs[4 * to + s] + ends[to] for to in range(4)) for s in range(4)]
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "block": batch.column("block"), "counts": batch.column("counts"), "ends": pa.array(out, NUMBERS), "last": pa.array(lasts, pa.bool_())})


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the cost, audit, roles and end from every state."""
    for batch in batches:
        for i, (own, vector, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("codes", "ends", "last")), strict=True)):
            at = layered(own, of_costs(vector))
            audits, roles, to = zip(*(traced(own, at, s, last) for s in range(4)), strict=True)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").slice(i, 1), "block": batch.column("block").slice(i, 1), "counts": batch.column("counts").slice(i, 1), "starts": pa.array([costs_of(*at[0])], NUMBERS), "audits": [list(audits)], "roles": [list(roles)], "to": pa.array([list(to)], NUMBERS)})


def _forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last: the trace that holds in each."""
    at, state, before = None, 0, 0
    for batch in batches:
        for i, (who, counts, starts, audits, roles, to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "counts", "starts", "audits", "roles", "to")), strict=True)):
            cost = 0
            if who != at:
                at, state, cost = who, 0, starts[0]
            elif (before, counts[4]) not in LEGAL:
                counts[3] += 1
            before = counts[5]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").slice(i, 1), "block": batch.column("block").slice(i, 1), "counts": pa.array([counts[:4]], NUMBERS), "cost": pa.array([cost], pa.int64()), "audit": [audits[state]], "roles": [roles[state]]})
            state = to[state]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit that leaves a turn, with the place in its block of the row it is made from (null: none)."""
    for batch in batches:
        for i, (audit, roles) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("audit", "roles")), strict=True)):
            nth, out = 0, []
            for pos, (edit, role) in enumerate(zip(audit, roles, strict=True)):
                if edit != "D":
                    out.append((pos, None if edit == "I" else nth, None if role == "-" else ROLES[" sua".index(role)]))
                nth += edit != "I"
            if out:
                some = pa.array([i] * len(out))
                pos, at, new = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(some), "block": batch.column("block").take(some), "pos": pa.array(pos, pa.int64()), "at": pa.array(at, pa.int64()), "new": pa.array(new, pa.string())})


def _long(coded: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The same fields for conversations of more rows, and their text in pieces (key, part, repaired)."""
    name = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = coded.select(name.alias("key"), "conv_id", "turn", "role", "text", "code", F.monotonically_increasing_id().alias("own"))
    rows = placed(rows, "key", ["turn", "role", "text", "own"])
    rows = staged(rows.withColumn("block", F.floor(F.col("place") / block)), "repair_rows")
    # the first of equal rows: a place is one row's, so no key of the join is hot
    first = rows.groupBy("key", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("same")).agg(F.min("place").alias("place"))
    first = first.select("key", "place", F.lit(0).alias("again"))
    codes = rows.select("key", "block", "place", "code").join(first, ["key", "place"], "left")
    codes = codes.select("key", "block", "place", (F.col("code") + F.coalesce("again", F.lit(DUPLICATE))).alias("code"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    blocks = staged(codes.groupBy("key", "block").agg(in_order.alias("codes")), "repair_blocks")

    told = blocks.mapInArrow(_tables, "key string, block long, costs array<bigint>, counts array<bigint>")
    backward = told.repartition("key").sortWithinPartitions("key", F.desc("block"))
    ends = staged(backward.mapInArrow(_back, "key string, block long, counts array<bigint>, ends array<bigint>, last boolean"), "repair_ends")
    ways = blocks.join(ends, ["key", "block"]).select("key", "block", "codes", "counts", "ends", "last")
    ways = ways.mapInArrow(_trace, "key string, block long, counts array<bigint>, starts array<bigint>, audits array<string>, roles array<string>, to array<bigint>")
    forward = ways.repartition("key").sortWithinPartitions("key", "block")
    chosen = staged(forward.mapInArrow(_forth, "key string, block long, counts array<bigint>, cost long, audit string, roles string"), "repair_chosen")

    sums = [F.sum(F.col("counts")[i]).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    found = chosen.groupBy("key").agg(*sums, F.sum("cost").alias("cost"), audit.alias("audit"))
    turns = rows.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id")).groupBy("key")
    turns = turns.agg(F.first("conv_id").alias("conv_id"), F.count("turn").alias("turns"), F.min("turn").cast("long").alias("low"), F.max("turn").cast("long").alias("high"))

    edits = chosen.select("key", "block", "audit", "roles").mapInArrow(_edits, "key string, block long, pos long, at long, new string")
    edits = edits.withColumn("place", F.col("block") * block + F.col("at"))
    made = edits.where("at IS NULL").select("key", "block", "pos", F.concat("new", F.lit(":")).alias("line"))
    stay = edits.where("at IS NOT NULL").join(rows.select("key", "place", "role", "text"), ["key", "place"])
    stay = stay.select("key", "block", "pos", F.concat(F.coalesce("new", "role"), F.lit(":"), "text").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    pieces = made.unionAll(stay).groupBy("key", F.struct("block", F.floor(F.col("pos") / JOINED).alias("piece")).alias("part")).agg(lines.alias("repaired"))
    return turns.join(found, "key").withColumn("repaired", F.lit(None).cast("string")), pieces


class Repaired(NamedTuple):
    """conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role:text lines; null for a long
    one), key (of a long one). pieces: key, part, repaired of long ones; their lines joined in the order of part, or None if
    there is no long one."""

    conversations: DataFrame
    pieces: DataFrame | None


def repair(conversations: DataFrame, block: int = BLOCK) -> Repaired:
    """The repair of each conversation of conversations (conv_id, turn, role, text)."""
    coded = _coded(conversations)
    conv_type = coded.schema["conv_id"].dataType.simpleString()
    long = staged(coded.groupBy("conv_id").count().where(F.col("count") > block).select(F.col("conv_id").alias("long_id")), "repair_long")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    some = not long.isEmpty()
    out = _short(coded.join(long, same, "left_anti") if some else coded, conv_type).withColumn("key", F.lit(None).cast("string"))
    pieces = None
    if some:
        found, pieces = _long(coded.join(long, same, "left_semi"), block)
        out = out.unionByName(found)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return Repaired(out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "key"), pieces)


def digested(repaired: Repaired) -> DataFrame:
    """The conversations with repaired_sha256 instead of their text. A long one's pieces are streamed in order, one at a time."""
    rows = repaired.conversations.withColumn("repaired_sha256", F.sha2("repaired", 256))
    if repaired.pieces is None:
        return rows.drop("repaired", "key")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        for batch in batches:
            for who, piece in zip(batch.column("long_key"), batch.column("piece"), strict=True):
                if who.as_py() != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = who.as_py(), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(piece.as_py().encode())
        if at is not None:
            done.append((at, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("long_key", "long_sha256"), (list(x) for x in zip(*done, strict=True)), strict=True)))

    dealt = repaired.pieces.select(F.col("key").alias("long_key"), "part", F.col("repaired").alias("piece")).repartition("long_key").sortWithinPartitions("long_key", "part")
    streamed = dealt.select("long_key", "piece").mapInArrow(stream, "long_key string, long_sha256 string")
    nothing = F.when(F.col("key").isNotNull(), F.sha2(F.lit(""), 256))  # a long one of which no row is left
    out = rows.join(streamed, F.col("key") == F.col("long_key"), "left")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "long_sha256", nothing)).drop("repaired", "key", "long_key", "long_sha256")


def structure(damage: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for every conv_id of conversations, with zeros, an empty audit and the digest of nothing where damage has no rows."""
    found = digested(repair(damage, block))
    ids = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    out = ids.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
