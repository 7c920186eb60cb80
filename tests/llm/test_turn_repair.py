import hashlib
import random
import re
import zlib

import pytest

from langweave.llm.turn_repair import (
    ENDS, INSERT, STATES, _backward, _forward, cheapest_edits, repair_damaged, repair_turns,
)

TURNS = "conv_id long, turn long, role string, text string"


def brute_force(turns, entry=0, ends=ENDS):
    """Labels relaxed until nothing changes."""
    best, changed = {(0, entry): (0, "")}, True
    while changed:
        changed = False
        for node, (cost, edits) in list(best.items()):
            for reached, price, letter in _forward(turns, node):
                label = (cost + price, edits + letter)
                if reached not in best or label < best[reached]:
                    best[reached], changed = label, True
    return min([best[(len(turns), s)] for s in ends if (len(turns), s) in best], default=None)


def test_search_equals_relaxation():
    random.seed(3)
    for _ in range(1500):
        turns = "".join(random.choice("suaxSUAX.") for _ in range(random.randint(0, 9)))
        entry, end = random.choice(STATES), random.choice(STATES)
        assert cheapest_edits(turns) == brute_force(turns), turns
        assert cheapest_edits(turns, entry, (end,)) == brute_force(turns, entry, (end,)), (turns, entry, end)


def test_steps_are_the_same_from_both_sides():
    for turns in ("", "s", "U.a", "xSa"):
        nodes = [(i, s) for i in range(len(turns) + 1) for s in STATES]
        there = {(n, m, p, x) for n in nodes for m, p, x in _forward(turns, n)}
        back = {(m, n, p, x) for n in nodes for m, p, x in _backward(turns, n)}
        assert there == back


@pytest.mark.parametrize(
    ("turns", "wanted"),
    [("", (0, "")), ("sua", (0, "KKK")), ("s", (2, "D")), ("uu", (1, "KR")), ("ua.", (2, "KKD")), ("u", (2, "D")), ("UA", (4, "DD"))],
)
def test_small_repairs(turns, wanted):
    assert cheapest_edits(turns) == wanted
    assert INSERT > 2


def expected(rows):
    """Damage, faults, edits and digest, turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, t, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            mine += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        symbols, seen, counts = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "." if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = brute_force(symbols)
        state, repaired, at = 0, [], 0
        for x in audit:
            wanted = 3 if state == 2 else 2
            if x in "RI":
                state = wanted
                repaired.append(("user" if wanted == 2 else "assistant") + ":" + ("" if x == "I" else mine[at][2]))
            if x == "K":
                state = 1 if mine[at][1][0] == "s" else wanted
                repaired.append(mine[at][1] + ":" + mine[at][2])
            at += x != "I"
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(frame):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in frame.collect()}


def awkward_rows():
    random.seed(8)
    texts = ["Yes.", "No!", "why?", "cut off", "", None, " \t", "ends. \n", "é. 😀", "long " * 20_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [
        (c, random.choice([None, *range(9)]), random.choice(roles[: 3 + 4 * (c % 2)]), random.choice(texts))
        for c in range(40)
        for _ in range(random.randint(1, 9))
    ]
    rows += [(None, t, "user", "Lost id.") for t in range(4)] + [(77, None, "user", "All null.")] * 3
    rows += [(78, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)] + rows[:20]
    return rows


def test_damaged_conversations_equal_brute_force(spark):
    rows = awkward_rows()
    frame = spark.createDataFrame(rows, TURNS).repartition(7).selectExpr("*", "1 as place", "'x' as digest", "2 as copy")
    assert found(repair_damaged(frame)) == expected(rows)


def test_blocks_of_long_conversations_join(spark):
    frame = spark.createDataFrame(awkward_rows(), TURNS)
    assert found(repair_turns(frame, block_turns=4)) == found(repair_turns(frame))


def test_a_conversation_that_lost_its_rows_and_an_empty_table(spark):
    lost = next((c, t) for c in range(1000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*lost, "user", "Gone.")], TURNS)
    assert found(repair_damaged(frame)) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert not found(repair_damaged(frame.limit(0)))
