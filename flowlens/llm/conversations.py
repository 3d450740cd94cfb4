"""Conversation structure repair by shortest paths with Dial's buckets.

A conversation's rows, in order of turn, are edited so that the initials of their roles read `(s?(ua)+)?`. Keep costs 0, Rerole
(to user or assistant, whichever may follow) 2, Delete 3, Insert (an empty text of that role) 2; a blank or repeated row has to be
deleted, a truncated one costs 1 more unless it is. Of the cheapest edits the audit is the one whose initials are least in ASCII.

Places between rows times the states of that pattern are the nodes of a graph whose arcs are edits. All costs are 0 to 3, so
distances to the end are found by buckets, one for each distance, without a heap. From the start the walk takes, at each node, the
tight arc (distance = cost + distance behind it) with the least letter. A letter and a state give one next state, so the walk is
the audit. Rows that have to go stay out of the graph: they cost 3 each, change no state, and D sorts before I.

Conversations may be of any size. Rows without their texts (equal rows counted) are dealt by ranges of conversation and turn and
cut into segments of SEGMENT rows in a row. A segment inside which a conversation begins and ends needs no other. For the rest each
segment gives the distances between the states at its two ends; these are added up from the last to the first segment of the
conversation, then each segment is walked from every state, and the walks that follow each other are taken. Texts are shuffled once,
sorted, and hashed as they stream by; a digest of a whole conversation is made in order, so in one task, which holds one row of it.

Null roles and texts are one space. Null turns come first; a null conv_id is a conversation of its own. Rows of one turn are ordered
by role and by MD5 of the text. Repeated rows are duplicates. Empty texts are blank; texts of any length are taken whole. Roles that
begin with none of s, u and a can't be kept. Other columns don't matter. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut

INSERT, REROLE, DELETE = 2, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the role that may be written from each state, and that role.
WRITTEN, ROLES = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
WRITERS = {to: [p for p in range(4) if WRITTEN[p] == to] for to in range(4)}
KEEPERS = {(initial, to): [p for p, q in moves.items() if q == to] for initial, moves in KEPT.items() for to in range(4)}
DONE = [0, None, None, 0]
LEGAL = {"su", "ua", "au"}
SEGMENT_BITS = 14
SPACE = "\t\n\x0b\x0c\r "
KEY = ["conv_id", "turn", "role", "hash"]
FAR = 1 << 60


class Row(NamedTuple):
    """A row of the graph: the initial of its role, and 1 if it is truncated."""

    initial: str
    late: int


def distances(rows: list[Row], ends: list[int | None]) -> list[int]:
    """Least cost from each node (4 * place + state) to the end, where `ends` are the costs from there on by state (None: no way).
    All are less by the least of `ends`."""
    least = min(e for e in ends if e is not None)
    out = [FAR] * (4 * len(rows) + 4)
    buckets: list[list[int]] = [[]]

    def reach(node: int, cost: int) -> None:
        if cost < out[node]:
            out[node] = cost
            while len(buckets) <= cost:
                buckets.append([])
            buckets[cost].append(node)

    for state, end in enumerate(ends):
        if end is not None:
            reach(4 * len(rows) + state, end - least)
    cost = 0
    while cost < len(buckets):
        for node in buckets[cost]:  # arcs of cost 0 lengthen the bucket under way
            if out[node] < cost:
                continue
            place, state = divmod(node, 4)
            for p in WRITERS[state]:
                reach(4 * place + p, cost + INSERT)
            if place:
                initial, late = rows[place - 1]
                reach(node - 4, cost + DELETE)
                for p in WRITERS[state]:
                    reach(4 * place - 4 + p, cost + REROLE + late)
                for p in KEEPERS.get((initial, state), ()):
                    reach(4 * place - 4 + p, cost + late)
        buckets[cost] = []
        cost += 1
    return out


def walk(rows: list[Row], far: list[int], state: int) -> tuple[list[tuple[str, int, int]], str]:
    """Letters, cost and state after each row on the least tight path, and the letters after the last row, if the path ends there."""
    out = []
    for i, (initial, late) in enumerate(rows):
        letters, cost = "", 0
        while True:
            here, to, kept = far[4 * i + state], WRITTEN[state], KEPT.get(initial, {}).get(state)
            if here == far[4 * i + 4 + state] + DELETE:
                letters, cost = letters + "D", cost + DELETE
            elif here == far[4 * i + to] + INSERT:
                letters, cost, state = letters + "I", cost + INSERT, to
                continue
            elif kept is not None and here == far[4 * i + 4 + kept] + late:
                letters, cost, state = letters + "K", cost + late, kept
            else:
                letters, cost, state = letters + "R", cost + REROLE + late, to
            break
        out.append((letters, cost, state))
    rest, at = "", 4 * len(rows)
    while far[at + state] == far[at + WRITTEN[state]] + INSERT:
        rest, state = rest + "I", WRITTEN[state]
    return out, rest


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of rows, damaged by crc32 of `conv_id:turn`, modulo 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right, where null keys equal each other."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, test, how).drop(*(f"_{c}" for c in on))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, hash (of the text), copies, blank, late (truncated) and fresh (not seen before: its first copy is no
    duplicate) of rows without their texts, equal ones as one."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    blank, late = trimmed == "", (trimmed != "") & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), "copies", blank.alias("blank"), late.alias("late"))
    slim = slim.groupBy(*KEY, "blank", "late").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = slim.where("copies > 0").groupBy("conv_id", "role", "hash").agg(F.min(when)["turn"].alias("first"))
    fresh = (F.col("copies") > 0) & F.col("turn").eqNullSafe(F.col("first"))
    return _joined(slim, firsts, ["conv_id", "role", "hash"]).withColumn("fresh", fresh).drop("first")


class Run(NamedTuple):
    """The rows of a conversation in a segment, as lists by column, and whether it may go on in other segments."""

    columns: dict[str, list]
    edge: bool

    def graph(self) -> tuple[list[bool], list[Row]]:
        """Which rows don't have to go, and these."""
        c = self.columns
        free = [fresh and not blank for fresh, blank in zip(c["fresh"], c["blank"], strict=True)]
        return free, [Row(r[:1], int(late)) for r, late, f in zip(c["role"], c["late"], free, strict=True) if f]


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    """The runs of rows that come in order."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b["segment"].to_numpy() == b["segment"].iloc[-1]
        rest = b[last]
        if not last.all():
            yield from _runs(b[~last])
    if rest is not None and len(rest):
        yield from _runs(rest)


def _runs(b: pd.DataFrame) -> Iterator[Run]:
    columns = {c: b[c].tolist() for c in b.columns}
    conv, seg = columns["conv_id"], columns["segment"]
    bounds = [0, *(i for i in range(1, len(b)) if conv[i] != conv[i - 1] or seg[i] != seg[i - 1]), len(b)]
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        edge = a == 0 or z == len(b) or seg[a - 1] != seg[a] or seg[z] != seg[a]
        yield Run({c: v[a:z] for c, v in columns.items()}, edge)


SUMMARY = ["conv_id", "segment", "place", "illegal", "head", "tail", "costs"]


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each run: illegal neighbours, first and last initial, and for runs at the edge of a segment the costs from each state at
    its begin to each at its end (16, -1: no way)."""
    out = []
    for run in runs(batches):
        own = run.columns
        initials = [r[:1] for r in own["role"]]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True)) + sum(own["copies"]) - len(initials)
        costs = None
        if run.edge:
            rows, costs = run.graph()[1], [-1] * 16
            for end in range(4):
                far = distances(rows, [0 if q == end else None for q in range(4)])
                for begin in range(4):
                    if far[begin] < FAR:
                        costs[4 * begin + end] = far[begin]
        out.append((own["conv_id"][0], own["segment"][0], own["place"][0], illegal, initials[0], initials[-1], costs))
        if len(out) >= 4096:
            yield pd.DataFrame(out, columns=SUMMARY)
            out = []
    yield pd.DataFrame(out, columns=SUMMARY)


def joints(own: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation of several segments: for each the costs from its end on, whether it is the first, and 1 if it meets the one
    before illegally."""
    own = own.sort_values("segment")
    heads, tails, ends, told = list(own["head"]), list(own["tail"]), DONE, []
    for costs in reversed(list(own["costs"])):
        told.append(ends)
        ways = [[costs[4 * p + q] + ends[q] for q in range(4) if costs[4 * p + q] >= 0 and ends[q] is not None] for p in range(4)]
        ends = [min(w) if w else None for w in ways]
    met = [0] + [int(a + b not in LEGAL) for a, b in zip(tails[:-1], heads[1:], strict=True)]
    return pd.DataFrame({
        "conv_id": own["conv_id"], "segment": own["segment"], "place": own["place"], "illegal": met, "first": [i == 0 for i in range(len(own))],
        "ends": [[-1 if e is None else e for e in x] for x in reversed(told)], "final": [i == len(own) - 1 for i in range(len(own))],
    })


STEPS = ["conv_id", "segment", "entry", "place", "turn", "role", "hash", "letters", "cost", "state"]


def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters, cost and state after each row of each run: from the start, or from every state where the run is no first one. Before
    the rows of a run that does not stand alone comes one of joints()."""
    out: dict[str, list] = {n: [] for n in STEPS}
    for run in runs(batches):
        own, first, final, ends = run.columns, True, True, DONE
        if own["kind"][0] == 0:
            first, final, ends = bool(own["first"][0]), bool(own["final"][0]), [None if e < 0 else int(e) for e in own["ends"][0]]
            run = Run({c: v[1:] for c, v in own.items()}, run.edge)
            own = run.columns
        free, rows = run.graph()
        far = distances(rows, ends)
        for entry in [START] if first else range(4):
            if far[entry] >= FAR:
                continue
            steps, rest = walk(rows, far, entry)
            steps, state, letters, costs = iter(steps), entry, out["letters"], out["cost"]
            for used, copies in zip(free, own["copies"], strict=True):
                step, cost, state = next(steps) if used else ("", 0, state)
                letters.append(step + "D" * (copies - used))
                costs.append(cost + DELETE * (copies - used))
                out["state"].append(state)
            if final:
                letters[-1], costs[-1] = letters[-1] + rest, costs[-1] + INSERT * len(rest)
            out["entry"] += [-1 if first and final else entry] * len(free)
            for n in ("conv_id", "segment", "place", "turn", "role", "hash"):
                out[n] += own[n]
        if len(out["entry"]) >= 1 << 14:
            yield pd.DataFrame(out)
            out = {n: [] for n in STEPS}
    if out["entry"]:  # Arrow takes empty lists for numbers
        yield pd.DataFrame(out)


def entries(own: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of a conversation is entered, from the states (state) that all entries lead to."""
    led = {(s, e): q for s, e, q in zip(own["segment"], own["entry"], own["state"], strict=True)}
    state, out = START, []
    for segment in sorted(set(own["segment"])):
        out.append((own["conv_id"].iloc[0], segment, state))
        state = led[segment, state]
    return pd.DataFrame(out, columns=["conv_id", "segment", "entry"])


def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv_id, cost, audit and digest of each conversation, from its edits and texts in order; a text follows its edit."""
    conv, begun, out = None, False, []
    audit: list[str] = []
    cost, state, digest, lines, owed = 0, START, hashlib.sha256(), 0, None

    def line(text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + text).encode("utf-8", "replace"))
        lines += 1

    def follow(letters: str, role: str, text: str) -> None:
        nonlocal state
        for x in letters:
            if x == "K":
                line(f"{role}:{text}")
                state = KEPT[role[:1]][state]
            elif x != "D":
                line(f"{ROLES[state]}:{text if x == 'R' else ''}")
                state = WRITTEN[state]

    for b in batches:
        for r in b[["conv_id", "kind", "role", "text", "letters", "cost"]].itertuples(index=False):
            own = None if pd.isna(r.conv_id) else r.conv_id
            if not begun or own != conv:
                if begun:
                    out.append((conv, cost, "".join(audit), digest.hexdigest()))
                conv, begun, audit, cost, state, digest, lines, owed = own, True, [], 0, START, hashlib.sha256(), 0, None
            if r.kind == 0:
                owed = r.letters
                audit.append(r.letters)
                cost += int(r.cost)
            elif owed is not None:
                follow(owed, r.role, r.text)
                owed = None
        if len(out) >= 4096:
            yield pd.DataFrame(out, columns=["conv_id", "cost", "audit", "repaired_sha256"])
            out = []
    if begun:
        out.append((conv, cost, "".join(audit), digest.hexdigest()))
    yield pd.DataFrame(out, columns=["conv_id", "cost", "audit", "repaired_sha256"])


def repair(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text, copies; a copy follows its row): gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    conv, turn = (F.col(c).cast("string") for c in ("conv_id", "turn"))  # pandas has no whole numbers beside nulls
    slim = faults(rows)
    dealt = slim.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("segment", F.shiftright("place", segment_bits)))
    n, some, worded = F.col("copies"), F.col("copies") > 0, ~F.col("blank")
    at = F.when(some, F.col("turn"))
    stats = dealt.groupBy("conv_id").agg(
        F.coalesce(F.max(at) - F.min(at) + 1 - F.count_distinct(at), F.lit(0)).cast("long").alias("gaps"),
        F.coalesce(F.sum(F.when(~worded, n)), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(worded, n - F.col("fresh").cast("long"))), F.lit(0)).alias("duplicate"),
        F.count_if(worded & F.col("fresh") & F.col("late")).alias("truncated"),
    )
    lean = dealt.where(some).withColumns({"conv_id": conv, "turn": turn, "kind": F.lit(1)})
    form = "conv_id string, segment long, place long, illegal long, head string, tail string, costs array<int>"
    summary = cut(lean.repartition(parts, "segment").sortWithinPartitions("place").mapInPandas(summaries, form))
    several = summary.where("costs is not null").groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    edges = _joined(summary, several, ["conv_id"], "left_semi")
    joint = cut(edges.groupBy("conv_id").applyInPandas(joints, "conv_id string, segment long, place long, illegal long, first boolean, ends array<int>, final boolean"))
    illegal = summary.select("conv_id", "illegal").unionByName(joint.select("conv_id", "illegal")).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    marks = joint.drop("illegal").withColumns({"kind": F.lit(0), "copies": F.lit(0).cast("long"), "blank": F.lit(False), "late": F.lit(False), "fresh": F.lit(False)})
    marked = lean.unionByName(marks, allowMissingColumns=True).repartition(parts, "segment").sortWithinPartitions("place", "kind")
    form = "conv_id string, segment long, entry int, place long, turn string, role string, hash binary, letters string, cost long, state int"
    steps = cut(marked.mapInPandas(walks, form))
    across = steps.where("entry >= 0")
    led = across.groupBy("conv_id", "segment", "entry").agg(F.max_by("state", "place").alias("state"))
    taken = led.groupBy("conv_id").applyInPandas(entries, "conv_id string, segment long, entry int")
    edits = steps.where("entry < 0").unionByName(_joined(across, taken, ["conv_id", "segment", "entry"], "left_semi"))
    edits = edits.select("conv_id", F.col("turn").cast(rows.schema["turn"].dataType).alias("turn"), "role", "hash", F.lit(0).alias("kind"), "letters", "cost")
    texts = rows.where(some).select(conv.alias("conv_id"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), F.lit(1).alias("kind"), "text")
    both = texts.unionByName(edits, allowMissingColumns=True).repartition(parts, "conv_id").sortWithinPartitions(*KEY, "kind")
    both = both.select("conv_id", "kind", "role", "text", "letters", F.coalesce("cost", F.lit(0)).alias("cost"))
    told = both.mapInPandas(written, "conv_id string, cost long, audit string, repaired_sha256 string")
    out = _joined(_joined(stats.select(conv.alias("conv"), *stats.columns), illegal.withColumnRenamed("conv_id", "conv"), ["conv"]), told.withColumnRenamed("conv_id", "conv"), ["conv"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _step(state: str, letter: str, cost: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}} END"


def _write(state: str, letter: str, role: str, late: str, text: str) -> str:
    return _step(state, letter, f"{REROLE} + {late}", f"chr(10) || '{role}:' || {text}")


#: The same rows by dynamic programming from the start: of each state the cheapest edits so far, with their letters and lines.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n, left(role, 1) AS i,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS own FROM damaged),
told AS (SELECT *, own = '' AS blank, own <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
  lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
r AS (SELECT *, blank OR duplicate AS forced, CASE WHEN NOT blank AND NOT duplicate AND right(own, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late FROM told),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, sum(late) AS truncated,
  count_if(n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS x0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS x1,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS x2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS x3 FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, n, {_step("x0", "D", "3")},
    CASE WHEN forced OR i <> 's' THEN {_step("x1", "D", "3")} ELSE least({_step("x1", "D", "3")}, {_step("x0", "K", "late", "chr(10) || role || ':' || text")}) END,
    CASE WHEN forced THEN {_step("y2", "D", "3")} ELSE least({_step("y2", "D", "3")}, {", ".join(_write(s, "R", "user", "late", "text") for s in ("x0", "x1", "y3"))},
      {", ".join("CASE WHEN i = 'u' THEN " + _step(s, "K", "late", "chr(10) || role || ':' || text") + " END" for s in ("x0", "x1", "y3"))}) END,
    CASE WHEN forced THEN {_step("y3", "D", "3")} ELSE least({_step("y3", "D", "3")}, {_write("y2", "R", "assistant", "late", "text")},
      CASE WHEN i = 'a' THEN {_step("y2", "K", "late", "chr(10) || role || ':' || text")} END) END
  FROM (SELECT *, least(x3, {_write("y2", "I", "assistant", "0", "''")}) AS y3 FROM (SELECT r.conv_id, r.n, x0, x1, x3, i, role, text, forced, late,
    least(x2, {", ".join(_write(s, "I", "user", "0", "''") for s in ("x0", "x1", "x3"))}) AS y2 FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n + 1))),
ends AS (SELECT dp.conv_id, least(x0, x3, {_write("y2", "I", "assistant", "0", "''")}) AS b FROM
  (SELECT *, least(x2, {", ".join(_write(s, "I", "user", "0", "''") for s in ("x0", "x1", "x3"))}) AS y2 FROM dp) dp
  JOIN (SELECT conv_id, max(n) AS n FROM r GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(substr(coalesce(b.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
