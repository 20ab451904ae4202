import hashlib
import heapq
import random
import zlib

import pytest

from chatloom.llm import conversation_repair as C

SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows, faults):
    """The least (cost, audit) by taking the cheapest unfinished edits one after another, as they are defined; and the lines."""
    n = len(rows)
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == n and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in ("user", "assistant"):
            if (state, r[0]) in to:
                heapq.heappush(queue, (cost + 5, audit + "I", i, r[0], (*lines, r + ":")))
        if i == n:
            continue
        (role, text), fault = rows[i], faults[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if (state, role[:1]) in to:
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
        for r in ("user", "assistant"):
            if (state, r[0]) in to:
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, r[0], (*lines, f"{r}:{text}")))
    raise AssertionError


def brute(table, damage=True):
    out, kept = {}, {}
    for conv, turn, role, text in table:
        role, text, rows = " " if role is None else role, " " if text is None else text, kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for r in rows:
            end = r[2].rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if r[1:] in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add(r[1:])
        cost, audit, text = cheapest([r[1:] for r in rows], faults)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, table, damage=True, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, code int, key string")
    rows = C.structure(C.damaged(df) if damage else df, df, **kw).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t\n", "a.b", None, "é. ", "x ", "end.　"]
    roles = ["user", "assistant", "system", "tool", None, "", "umpire", "User"]
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            text = rng.choice(texts) if rng.random() < 0.3 else f"{rng.randrange(6)} words."
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_cheapest_paths(spark, seed):
    table = conversations(seed, 150, 14)
    table += [(None, 1, "user", "A."), (None, None, "assistant", None), (-5, 3, "user", "B" * 70000), (-5, 3, "user", "B" * 70000)]
    rng = random.Random(seed)
    rng.shuffle(table)
    assert found(spark, table) == brute(table)
    assert found(spark, table, damage=False) == brute(table, damage=False)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_long_conversations_are_cut_in_blocks(spark, block):
    table = conversations(5, 25, 60) + [(99, t, "user" if t % 3 else "assistant", "same." if t % 4 else f"text {t}") for t in range(400)]
    table += [(100, t, "tool", "") for t in range(30)] + [(None, t, "assistant", "So be it.") for t in range(20)]
    assert found(spark, table, block=block) == brute(table)
    assert found(spark, table, damage=False, block=block) == brute(table, damage=False)


def test_nothing_left_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert found(spark, [(gone, 1, "user", "Yes.")]) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert found(spark, []) == {}


def test_layers_hold_every_least_cost():
    """13 layers lose no state: the costs of all states against a table of least costs."""
    rng = random.Random(3)
    step = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}, 0: {}}
    for _ in range(300):
        codes = [rng.randrange(4) + rng.choice([0, 0, 0, 4, 8, 16]) for _ in range(rng.randrange(1, 40))]
        costs = [0, C.NEVER, C.NEVER, 0]

        def insert(c):
            for _ in range(3):
                c = [min([c[s]] + [5 + c[t] for letter in (2, 3) for a, t in step[letter].items() if a == s]) for s in range(4)]
            return c

        costs = insert(costs)
        at = C.layered(codes, C.END)
        for i in range(len(codes) - 1, -1, -1):
            code = codes[i]
            new = []
            for s in range(4):
                ways = [2 + costs[s]]
                if not code & 20:
                    more = 5 if code & 8 else 0
                    ways += [more + costs[t] for a, t in step[code & 3].items() if a == s]
                    ways += [more + 1 + costs[t] for letter in (2, 3) for a, t in step[letter].items() if a == s]
                new.append(min(ways))
            costs = insert(new)
            assert C.costs_of(*at[i]) == costs
