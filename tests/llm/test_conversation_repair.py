"""Repair of conversations against a table of cheapest letters, row by row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import conversation_repair as cr, queries

SF = "/root/testdata/sf0.001"
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def put_in(best):
    best = dict(best)
    for _ in range(3):
        for s in range(4):
            for i, to in AFTER[s].items():
                if i != "s":
                    cost, letters, lines = best[to]
                    more = (cost + 2, f"I{letters}", (f"{NAMES[i]}:", *lines))
                    best[s] = min(best[s], more, key=lambda x: x[:2])
    return best


def brute(rows):
    """Cheapest letters from every state, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "truncated" if end[-1:] not in ".!?" else ""
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else fault)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    end, never = (0, "", ()), (10**9, "", ())
    best = put_in({0: end, 1: never, 2: never, 3: end})
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for s in range(4):
            cost, letters, lines = best[s]
            ways = [(cost + 3, f"D{letters}", lines)]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for letter, i, name, price in (
                    ("K", role[:1], role, 0), ("R", "u", "user", 2), ("R", "a", "assistant", 2)
                ):
                    if i in AFTER[s]:
                        cost, letters, lines = best[AFTER[s][i]]
                        ways.append((cost + price + extra, f"{letter}{letters}", (f"{name}:{text}", *lines)))
            now[s] = min(ways, key=lambda x: x[:2])
        best = put_in(now)
    cost, letters, lines = best[0]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, letters, digest


def wanted(rows):
    by = defaultdict(list)
    for conv, *row in damage(rows):
        by[conv].append(tuple(row))
    return {conv: brute(by[conv]) for conv in {r[0] for r in rows}}


def result(turns):
    found = cr.report(cr.damaged(turns), turns, "copies").select(*COLUMNS).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


def rows_of(turns):
    return [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]


KINDS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def random_turns(spark):
    rng = random.Random(1)
    rows = []
    for c in range(150):
        conv = None if c == 0 else 7 if c < 30 else c
        for t in range(rng.randint(0, 14)):
            turn = rng.choice([None, t, t, 2 * t]) if rng.random() < 0.3 else t
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            some = rng.choice(["Hi.", "Yo", "  ", "", None, "A b.\n", "x!", "q? "])
            rows.append((conv, turn, role, some if rng.random() < 0.6 else f"text {rng.random()}."))
    turns = spark.createDataFrame(rows, KINDS)
    return turns.selectExpr("*", "'z' as copies", "1 as id", "2 as part", "'y' as symbol", "0 as cost")


def test_report_equals_brute_force(random_turns):
    assert result(random_turns) == wanted(rows_of(random_turns))


@pytest.fixture
def many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_conversations_over_many_parts(spark, many_parts, random_turns):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"m{i}{rng.choice(['.', ''])}") for i in range(3000)]
    rows += [(2, i, "user", f"m{i}.") for i in range(2000)] + [(3, 1, "user", "A.")]
    turns = spark.createDataFrame(rows, KINDS)
    assert cr._ordered(turns, None).selectExpr("shiftright(id, 33) as p").distinct().count() > 2
    assert result(turns) == wanted(rows)
    assert result(random_turns) == wanted(rows_of(random_turns))


def test_repeated_rows_are_one(spark):
    turns = spark.createDataFrame([(1, 1, "user", "A.")] * 500 + [(1, 2, "assistant", "B.")], KINDS)
    repaired = cr.repair(turns)
    assert repaired.count() == 2
    r = cr.digests(repaired).collect()[0]
    assert (r["audit"], r["duplicate"], r["illegal"], r["cost"]) == (f"K{'D' * 499}K", 499, 499, 1497)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], KINDS)
    assert cr.repair(nothing).collect() == [] and result(nothing) == {}


def test_a_conversation_that_is_lost(spark):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    turns = spark.createDataFrame([(lost, 1, "user", "A.")], KINDS)
    assert result(turns) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_runs_are_passed_by_powers():
    rng = random.Random(3)
    for _ in range(300):
        runs = [(rng.randrange(9), rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        for state in range(4):
            assert cr.unroll(runs, state, cr.AT_END) == cr.unroll(single, state, cr.AT_END)
        assert cr.applied(cr.run_matrix(runs), cr.AT_END) == cr.applied(cr.run_matrix(single), cr.AT_END)


def test_query_on_the_tables(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, SF)
    assert set(COLUMNS) <= set(got.columns)
    assert {r[0]: tuple(r)[1:] for r in got.select(*COLUMNS).collect()} == wanted(rows_of(turns))
