import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lettermill.llm import conversation_repair as repair
from lettermill.llm.work import table

from ..oracle import connection, spark_rows, sql_rows

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}


def with_inserts(ways):
    """ways: cost, edits and lines from each state to the end."""
    out = dict(ways)
    for _, (q, arcs) in itertools.product(range(4), NEXT.items()):
        for i, after in arcs.items():
            if i in ROLE and after in out:
                way = (out[after][0] + 2, "I" + out[after][1], (ROLE[i] + ":",) + out[after][2])
                if q not in out or way[:2] < out[q][:2]:
                    out[q] = way
    return out


def cheapest(rows, faults):
    """From the last row back, with edits spelled out."""
    ways = with_inserts({0: (0, "", ()), 3: (0, "", ())})
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for q in range(4):
            some = [(ways[q][0] + 3, "D" + ways[q][1], ways[q][2])] if q in ways else []
            if fault not in ("blank", "duplicate"):
                for i, after in NEXT[q].items():
                    if after not in ways:
                        continue
                    more = ways[after][0] + (fault == "truncated")
                    if role[:1] == i:
                        some.append((more, "K" + ways[after][1], (f"{role}:{text}",) + ways[after][2]))
                    if i in ROLE:
                        some.append((more + 2, "R" + ways[after][1], (f"{ROLE[i]}:{text}",) + ways[after][2]))
            if some:
                now[q] = min(some, key=lambda w: w[:2])
        ways = with_inserts(now)
    return ways[0]


def expected(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            marks = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    made = random.Random(4)
    for conv in [*range(30), None]:
        for turn in range(made.choice([1, 3, 8, 30, 150])):
            role = made.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "udder"])
            text = made.choice([None, "", "a", "a.", "b!", "c?", "no end", "é. ", " \t.", "\x0b ", f"unique {made.randrange(1000)}.", f"unique {made.randrange(1000)}"])
            yield conv, made.choice([turn, turn, turn, None, made.randrange(20)]), role, text


def test_query_matches_sql(spark, small):
    assert spark_rows(repair.op13_conversation_repair(spark, small)) == sql_rows(connection(small), repair.OP13_SQL)


@pytest.mark.parametrize("bounds", [{}, {"ranges": 3, "block_rows": 4, "fan": 2}, {"ranges": 2, "block_rows": 3}])
def test_repairs_match_a_loop(spark, bounds):
    """Also where conversations lie in many blocks and ranges."""
    rows = list(odd_rows())
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int, gone string, part int")
    got = {r["conv"]: tuple(r)[1:] for r in repair.repaired(repair.damaged(frame), **bounds).collect()}
    assert got == expected(rows)
    assert repair.repaired(repair.damaged(frame.limit(0)), **bounds).count() == 0


def test_all_short_conversations():
    """Every row pattern of up to four rows, against all ways spelled out."""
    kinds = [(role, fault) for role in ("system", "user", "assistant", "tool") for fault in (repair.NONE, repair.BLANK, repair.TRUNCATED)]
    names = {repair.NONE: "", repair.BLANK: "blank", repair.TRUNCATED: "truncated"}
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            want = cheapest([(0, role, "x") for role, _ in rows], [names[f] for _, f in rows])
            roles = [role for role, _ in rows]
            cost, audit = repair.repair(roles, [f for _, f in rows])
            assert (cost, audit, tuple(repair.repaired_lines(roles, ["x"] * n, audit))) == want


def test_one_conversation_of_many_rows(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"text {k}." if k % 5 else "same.") for k in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv"]: tuple(r)[1:] for r in repair.repaired(repair.damaged(frame), ranges=5).collect()}
    assert got == expected(rows)


def test_prices_never_exceed_distances(small, spark):
    rows = table(spark, small, "conversations").where("conv_id = 0").orderBy("turn").collect()
    layers = [*repair.layers_of([r["role"] for r in rows], [repair.NONE, repair.TRUNCATED] * (len(rows) // 2) + [repair.BLANK] * (len(rows) % 2)), repair._CLOSE]
    prices = [0] * (4 * len(layers) + 4)
    repair.auction(layers, 0, 4 * len(layers), prices)
    for node in range(4 * len(layers)):
        for _, cost, offset in layers[node >> 2][node & 3]:
            assert prices[node] <= cost + prices[node + offset]
