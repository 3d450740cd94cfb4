"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start in shards by rank, then move: in each round a document
wants the open shard in which most documents of its group are, if that is more than where it is. Quotas bound the moves
from each shard to each other so that no shard exceeds its capacity; whole ranges of hashes move, so a small group moves
together and a large one fills one shard after another. A shard that nothing fits into any more is shut. Rounds end when nothing moves. Documents without links then fill
the shards to capacity. Capacities differ by one row at most (law "rows"), so this law holds exactly, however large a group
is; a group is cut only where it can't be helped or rounds end.

Everything is DataFrame functions; what reaches the driver has a row for each pair of shards and range, never more. Ranks
come from counts by hash range, prefix-summed, and row numbers within a range, so no task sorts all rows. Groups and wishes
are written as tables, so that joins can split a group that holds much of them.

Null texts have size 1 and no links; empty texts are equal texts. Null ids are ids like others. Rows equal in id and text are
numbered first, by ranges too, so that they hash apart. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._spark import cut

RANGES = 4096
MOVE_RANGES = 64


def numbered(df: DataFrame, within: list[str], order: list[Column], into: str, ranges: int = RANGES) -> DataFrame:
    """df with the rank from 0 by `order` hash within the columns `within`, which have few values."""
    keyed = df.withColumn("_hash", F.xxhash64(*order)).withColumn("_range", F.pmod("_hash", F.lit(ranges)))
    counts = keyed.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = Window.partitionBy(*within, "_range").orderBy("_hash", *order)
    ranked = keyed.withColumn("_row", F.row_number().over(at) - 1).join(F.broadcast(offsets), [*within, "_range"])  # ranges rows for each value
    return ranked.withColumn(into, F.col("_offset") + F.col("_row")).drop("_hash", "_range", "_offset", "_row")


def told_apart(df: DataFrame, ranges: int = 64) -> DataFrame:
    """df (doc_id, group) with turn: 0, and numbers from 0 for rows that are equal in both."""
    rows = cut(df.withColumn("_key", F.xxhash64("doc_id", "group")).withColumn("_id", F.monotonically_increasing_id()))
    again = cut(rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    twice = rows.join(again, "_key").withColumn("_range", F.pmod(F.xxhash64("_id"), F.lit(ranges)))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = twice.groupBy("_key", "_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = Window.partitionBy("_key", "_range").orderBy("_id")
    numbers = twice.withColumn("_row", F.row_number().over(at) - 1).join(offsets, ["_key", "_range"]).select(*df.columns, (F.col("_offset") + F.col("_row")).cast("long").alias("turn"))
    once = rows.join(again, "_key", "left_anti").select(*df.columns, F.lit(0).cast("long").alias("turn"))
    return once.unionByName(numbers)


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def quotas(wanted: dict[tuple[int, int], int], spare: list[int]) -> dict[tuple[int, int], float]:
    """Largest shares of the wanted moves, by steps, with no more into a shard than its spare rows and what leaves it."""
    flow = {k: float(v) for k, v in wanted.items()}
    for _ in range(200):
        into, out = defaultdict(float), defaultdict(float)
        for (i, j), v in flow.items():
            into[j] += v
            out[i] += v
        over = {j: (spare[j] + out[j]) / v for j, v in into.items() if v > spare[j] + out[j] + 1e-9}
        if not over:
            break
        flow = {(i, j): v * max(0.0, over.get(j, 1.0)) for (i, j), v in flow.items()}
    return flow


def accepted(ranges: dict[tuple[int, int], dict[int, int]], spare: list[int]) -> dict[tuple[int, int], set[int]]:
    """Ranges of hashes that may move between each two shards; after them no shard is over its capacity."""
    quota = quotas({k: sum(v.values()) for k, v in ranges.items()}, spare)
    take: dict[tuple[int, int], set[int]] = {}
    moved: dict[tuple[int, int], int] = {}
    for k, counts in ranges.items():
        room, take[k] = quota[k] + 1e-6, set()
        for r in sorted(counts):
            if counts[r] <= room:
                room -= counts[r]
                take[k].add(r)
        moved[k] = sum(counts[r] for r in take[k])
    while True:  # ranges are whole, so less may leave a shard than its quota: give back until all fits
        net = defaultdict(int)
        for (i, j), v in moved.items():
            net[j] += v
            net[i] -= v
        over = [j for j, v in net.items() if v > spare[j]]
        if not over:
            break
        k = max((k for k in moved if k[1] in over and moved[k]), key=lambda k: (moved[k], k))
        r = max(take[k])
        take[k].discard(r)
        moved[k] -= ranges[k][r]
    for k in sorted(ranges):  # then whatever still fits
        for r in sorted(set(ranges[k]) - take[k]):
            if net[k[1]] + ranges[k][r] <= spare[k[1]]:
                take[k].add(r)
                net[k[1]] += ranges[k][r]
                net[k[0]] -= ranges[k][r]
    return take


def propagate(members: DataFrame, spare: list[int], rounds: int = 32, large: int = 1000) -> DataFrame:
    """Move members (row, group, n: size of the group, shard); spare: rows that each shard can still take."""
    state, spare, shut = cut(members), list(spare), set()
    for turn in range(rounds):
        is_open = F.element_at(F.array(*(F.lit(s > 0 and j not in shut) for j, s in enumerate(spare))), F.col("shard") + 1)
        tally = state.groupBy("group", "shard").agg(F.count("*").alias("count"))
        of_group = Window.partitionBy("group")  # a row for each shard at most
        rank = F.struct("count", F.xxhash64("group", "shard").alias("tie"), "shard")
        wish = tally.withColumn("rank", rank).withColumn("best", F.max(F.when(is_open, rank)).over(of_group)).where(F.col("best") > F.col("rank"))
        wish = cut(wish.select("group", "shard", F.col("best.shard").alias("target")))
        moves = state.join(wish, ["group", "shard"], "left")
        together = F.when(F.col("n") < large, F.xxhash64("group", F.lit(turn))).otherwise(F.xxhash64("row", F.lit(turn)))
        moves = cut(moves.withColumn("range", F.pmod(together, F.lit(MOVE_RANGES)).cast("int")))
        ranges: dict = defaultdict(dict)
        for r in moves.where("target is not null").groupBy("shard", "target", "range").agg(F.count("*").alias("k")).collect():  # shards**2 * MOVE_RANGES rows
            ranges[r["shard"], r["target"]][r["range"]] = r["k"]
        take = accepted(ranges, spare)
        gone = {k: sum(ranges[k][r] for r in v) for k, v in take.items()}
        stuck = {j for _, j in gone} - {j for (_, j), k in gone.items() if k}
        if not any(gone.values()) and not stuck - shut:
            return moves.select(state.columns)
        shut |= stuck  # no range that wants to go there fits any more
        for (i, j), k in gone.items():
            spare[i] += k
            spare[j] -= k
        allowed = {f"{i}>{j}": sorted(v) for (i, j), v in take.items() if v}
        if not allowed:
            continue
        may = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        way = F.concat_ws(">", F.col("shard").cast("string"), F.col("target").cast("string"))
        goes = F.coalesce(F.array_contains(may[way], F.col("range")), F.lit(False))
        state = moves.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).select(state.columns)
    return cut(state)


def shard(df: DataFrame, shards: int = 16, rounds: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    raw = F.col("text").cast("binary")
    slim = cut(told_apart(df.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"), F.md5(raw).alias("group"))))
    groups = cut(slim.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    split = slim.join(groups, "group", "left").withColumn("linked", F.col("n").isNotNull())
    rows = cut(numbered(split, ["linked"], [F.col("doc_id"), F.col("group"), F.col("turn")], "row"))
    totals = {r["linked"]: r["k"] for r in rows.groupBy("linked").agg(F.count("*").alias("k")).collect()}
    most = capacities(sum(totals.values()), shards)
    linked = rows.where("linked").withColumn("shard", (F.col("row") % shards).cast("int"))
    begun = capacities(totals.get(True, 0), shards)
    large = max(2, most[-1] // MOVE_RANGES)
    settled = propagate(linked.select("row", "group", "n", "shard"), [m - b for m, b in zip(most, begun, strict=True)], rounds, large)
    held = {r["shard"]: r["k"] for r in settled.groupBy("shard").agg(F.count("*").alias("k")).collect()}
    placed = numbered(rows.where("linked").drop("group", "n").join(settled.select("row", "shard"), "row"), ["shard"], [F.col("row")], "slot", RANGES // 4)
    starts, total = [], 0
    for j in range(shards):
        starts.append(total)
        total += most[j] - held.get(j, 0)
    begins = F.array(*(F.lit(s).cast("long") for s in starts))
    free = rows.where("not linked").withColumn("shard", F.size(F.filter(begins, lambda b: b <= F.col("row"))) - 1)
    first = F.array(*(F.lit(held.get(j, 0) - starts[j]).cast("long") for j in range(shards)))
    free = free.withColumn("slot", F.col("row") + F.element_at(first, F.col("shard") + 1))
    columns = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    return placed.select(*columns).unionByName(free.select(*columns))
