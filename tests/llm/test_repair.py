import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

import llm_cases as C
from clickstack.llm import repair
from clickstack.llm.queries import ORACLE, QUERIES
from compare import rows_of

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ADD = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, initials) by dynamic programming over (cost, initials); turns are (initial, must, cut)."""
    def closure(best):
        for _ in range(4):
            for q in list(best):
                c, w = best[q][0] + 2, best[q][1] + "I"
                if ADD[q] not in best or (c, w) < best[ADD[q]]:
                    best[ADD[q]] = (c, w)
        return best
    best = closure({"": (0, "")})
    for role, must, cut in turns:
        new = {}
        for q, (c, w) in best.items():
            ways = [(q, c + 3, "D")]
            if not must:
                ways.append((ADD[q], c + 2 + cut, "R"))
                if role in NEXT[q]:
                    ways.append((NEXT[q][role], c + cut, "K"))
            for to, cost, a in ways:
                if to not in new or (cost, w + a) < new[to]:
                    new[to] = (cost, w + a)
        best = closure(new)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """Expected result per conversation of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        mine += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), int(fault == 2)))
        cost, audit = cheapest(marks)
        state, lines, todo = "", [], list(turns)
        for a in audit:
            role, text = ("", "") if a == "I" else todo.pop(0)[1:]
            if a == "D":
                continue
            state = NEXT[state][role[0]] if a == "K" else ADD[state]
            lines.append((role if a == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and not todo
        nums = {r[0] for r in turns} - {None}
        out[conv] = (max(nums) - min(nums) + 1 - len(nums) if nums else 0, *counts,
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(df, got):
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == want[r.conv_id], r


@pytest.mark.parametrize("sf", [C.SMALL, "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/conversations.parquet"), QUERIES["op12_repair"](spark, sf))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{C.SMALL}/conversations.parquet'")
    df, rel = QUERIES["op12_repair"](spark, C.SMALL), con.sql(ORACLE["op12_repair"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_auction_against_dynamic_programming():
    rng = random.Random(5)
    for n in [*range(6), 30, 200]:
        for _ in range(150 if n < 30 else 10):
            s = bytes(rng.choice([0, 1, 2, 1, 2, 1, 2, 3, 5, 6, 9, 10]) for _ in range(n))
            a = repair.Auction(s, repair.CLOSE)
            letters, state = a.trace(0)
            assert (a.price[0], letters + repair.CLOSING[state]) == cheapest([(
                "sua?"[x & 3], bool(x & 4), x >> 3) for x in s])


def test_segment_costs_add_up():
    rng = random.Random(6)
    for _ in range(60):
        s = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 10, 8]) for _ in range(rng.randint(0, 12)))
        for cut in range(len(s) + 1):
            assert repair._through(repair.costs(s[:cut]), repair.costs(s[cut:])) == repair.costs(s)


def awkward():
    rng = random.Random(7)
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool", "", None, "umpire"]),
             rng.choice(["Fine.", "Fine.", "cut off", "", None, " \t", "x!  ", "漢字?", "a:b\nc."]))
            for i in range(60) for t in rng.sample([None, *range(-2, 12)], rng.randint(1, 9)) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(None, 1, "user", "No id."), (None, None, "assistant", None), (None, None, None, "A.")]
    rows += [(1 << 62, t, ("user", "assistant")[t % 2], f"Turn {t % 900}.") for t in range(2500)]   # spans segments
    rows += [(5000, 3, "user", "Same.")] * 3000 + [(5001, 1, "user", "x" * 500_000)]
    return rows


def test_awkward_rows(spark, monkeypatch):
    df = spark.createDataFrame(awkward(), "conv_id long, turn long, role string, text string").selectExpr(
        "*", *[f"'{c}' as {c}" for c in ("conv", "seg", "tie", "copy", "k", "letters", "cost", "idx", "m", "n", "mono", "id")])
    check(df, repair.repaired(df))
    monkeypatch.setattr(repair, "FAN", 2)   # several levels of blocks
    check(df, repair.repaired(df))
    assert repair.repaired(df.where("false")).collect() == []


def test_every_small_audit_is_least():
    """Against the least of all edit strings, on every conversation of up to three turns."""
    for n in range(4):
        for turns in itertools.product([("s", False, 0), ("u", False, 0), ("a", False, 1), ("u", True, 0), ("?", False, 0)], repeat=n):
            best = None
            for length in range(n, n + 5):
                for w in itertools.product("DIKR", repeat=length):
                    if sum(x != "I" for x in w) != n:
                        continue
                    state, cost, i = "", 0, 0
                    for a in w:
                        if a == "I":
                            state, cost = ADD[state], cost + 2
                            continue
                        role, must, cut = turns[i]
                        i += 1
                        if a == "D":
                            cost += 3
                        elif must or (a == "K" and role not in NEXT[state]):
                            break
                        else:
                            state, cost = (NEXT[state][role], cost + cut) if a == "K" else (ADD[state], cost + 2 + cut)
                    else:
                        if state in ("", "a") and (best is None or (cost, w) < best):
                            best = (cost, w)
            assert cheapest(turns) == (best[0], "".join(best[1]))
