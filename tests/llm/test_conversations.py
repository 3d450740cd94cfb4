"""Repair of conversations against plain dynamic programming, over every kind of row and of any number of segments."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from flowlens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, hash string, segment int, place int, state int, cost double, copies string"
EXTRA = ("k", "h", 1, 2, 3, 0.5, "c")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Cheapest edits by the state they lead to: cost, letters, lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    best, seen, n, late_rows = {"": (0, "", ())}, set(), Counter(), 0

    def inserted(best):
        for _ in range(4):
            for state, (cost, letters, lines) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 2, letters + "I", (*lines, f"{role}:"))
                best[role[0]] = min(best.get(role[0], new), new)
        return best

    for turn, role, text in rows:
        best = inserted(dict(best))
        trimmed = text.strip(" \t\n\v\f\r")
        forced = "blank" if not trimmed else "duplicate" if (role, text) in seen else None
        seen.add((role, text))
        n[forced] += forced is not None
        late = int(forced is None and trimmed[-1] not in ".!?")
        late_rows += late
        new = {}
        for state, (cost, letters, lines) in best.items():
            ways = [(state, (cost + 3, letters + "D", lines))]
            if not forced:
                to = "assistant" if state == "u" else "user"
                ways.append((to[0], (cost + 2 + late, letters + "R", (*lines, f"{to}:{text}"))))
                if role[:1] and role[0] in NEXT[state]:
                    ways.append((role[0], (cost + late, letters + "K", (*lines, f"{role}:{text}"))))
            for q, w in ways:
                new[q] = min(new.get(q, w), w)
        best = new
    best = inserted(dict(best)) if rows else best
    cost, letters, lines = min(best[q] for q in ("", "a") if q in best)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], late_rows, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(seed, conversations_, longest):
    r, rows = random.Random(seed), []
    for conv in [None, *range(conversations_)]:
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "Ärger"])
            text = r.choice(["Yes.", "No!", "cut", "", " \t", None, "a", "Why?", "x" * 3000 + ".", "é…", "end. ", "u v"])
            rows += [(conv, r.choice([turn, turn, turn, turn, 3, None]), role, text)] * r.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize(("seed", "count", "longest", "bits"), [(1, 40, 9, 14), (2, 12, 30, 2), (3, 3, 160, 3), (4, 25, 4, 0)])
def test_repair_equals_dynamic_programming_and_sql(spark, seed, count, longest, bits):
    rows = made(seed, count, longest)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, conversations.repair(conversations.damage(df), segment_bits=bits).collect())))
    own = damaged(rows)
    want = sorted(repr((conv, *repaired(own[conv]))) for conv in {r[0] for r in rows})
    assert got == want
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(repr, c.execute(conversations.ORACLE_SQL).fetchall())) == want


def test_no_rows(spark):
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_distances_are_bounded_by_what_is_cheaper():
    rows = [conversations.Row("u", 0), conversations.Row("a", 1), conversations.Row("a", 0)]
    far = conversations.distances(rows, conversations.DONE)
    assert far[conversations.START] == 3  # keeping both rows and deleting the truncated one
    assert conversations.walk(rows, far, conversations.START)[0] == [("K", 0, 2), ("D", 3, 2), ("K", 0, 3)]
