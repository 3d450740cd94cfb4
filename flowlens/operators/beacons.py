"""How regular the gaps of flows are: of whole flows by blocks, and of each prefix of a flow."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import flows
from flowlens.operators.combinators import dealt, medians

FLOW = ["capture_id", "flow_id"]


class Gaps:
    """Gaps between times that come one after the other, with what regularity asks of them. An insertion takes one bisection."""

    def __init__(self):
        self.times, self.gaps, self.total, self.square = [], [], 0, 0

    def _count(self, gap: int, sign: int) -> None:
        self.total, self.square = self.total + sign * gap, self.square + sign * gap * gap
        if sign > 0:
            insort(self.gaps, gap)
        else:
            del self.gaps[bisect_left(self.gaps, gap)]

    def add(self, time: int) -> None:
        at = bisect_left(self.times, time)
        before, after = self.times[at - 1 : at] if at else [], self.times[at : at + 1]
        if before and after:
            self._count(after[0] - before[0], -1)
        for gap in [time - b for b in before] + [a - time for a in after]:
            self._count(gap, 1)
        self.times.insert(at, time)

    def spread(self) -> tuple[float, float]:
        """Mean and standard deviation in seconds."""
        n = len(self.gaps)
        return self.total / n / 1e6, math.sqrt(max(self.square * n - self.total * self.total, 0)) / n / 1e6

    def middle(self) -> tuple[float, float]:
        """Median and median absolute deviation in seconds: the k nearest gaps to the median are a run of the sorted ones."""
        g, n = self.gaps, len(self.gaps)
        median = (g[(n - 1) // 2] + g[n // 2]) / 2

        def kth(k: int) -> float:
            low, high = 0, n - k  # the run of k gaps from `low` whose farther end is nearest
            while low < high:
                at = (low + high) // 2
                low, high = (at + 1, high) if median - g[at] > g[at + k] - median else (low, at)
            return max(median - g[low], g[low + k - 1] - median)

        return median / 1e6, (kth((n - 1) // 2 + 1) + kth(n // 2 + 1)) / 2 / 1e6

    def regular(self, own: dict) -> tuple[int, float, float, float, float] | None:
        """n, mean, stddev, median and median absolute deviation of gaps that are regular."""
        mean, spread = self.spread()
        if mean <= 0.001 or spread / mean > own["max_cov"]:
            return None
        median, mad = self.middle()
        return (len(self.gaps), mean, spread, median, mad) if median > 0.001 and mad / median <= own["max_mad_ratio"] else None


class Prefix:
    """A flow packet by packet. Packets without payload count only while there are too few others."""

    def __init__(self, own: dict, packets: list[tuple[int, bool]] = ()):
        self.own, self.every, self.filled, self.start = own, Gaps(), Gaps(), None
        for time, full in packets:
            self._take(time, full)

    def _take(self, time: int, full: bool) -> None:
        self.start = time if self.start is None else self.start
        self.every.add(time)
        if full:
            self.filled.add(time)

    def _used(self) -> Gaps | None:
        if len(self.every.times) < self.own["min_samples"]:
            return None
        return self.filled if len(self.filled.times) >= self.own["min_samples"] else self.every

    def add(self, time: int, full: bool) -> tuple | None:
        """Numbers of the gaps if they are regular with this packet, and the flow is long enough."""
        self._take(time, full)
        used = self._used()
        return used.regular(self.own) if used and (time - self.start) / 1e6 >= self.own["min_duration_sec"] else None

    def whole(self) -> tuple | None:
        """Numbers of the gaps if they are regular, however short the flow is."""
        used = self._used()
        return used.regular(self.own) if used else None


def intervals(packets: DataFrame, least: int) -> DataFrame:
    """Gaps in microseconds between packets of flows that have `least` packets or more; packets without payload count only in
    flows that have less than `least` others. Packets are dealt by ranges of flow and time; a range hands its last time on."""
    rows = flows.with_flow(packets).select(*FLOW, "seq", "ts_us", "payload_len")
    sizes = rows.groupBy(*FLOW).agg(F.count("*").alias("all"), F.count_if(F.col("payload_len") > 0).alias("full")).where(F.col("all") >= least)
    used = dealt(rows.join(sizes, FLOW).where((F.col("full") < least) | (F.col("payload_len") > 0)).select(*FLOW, "ts_us", "seq"), [*FLOW, "ts_us", "seq"])
    last = used.groupBy(*FLOW, "_block").agg(F.max("ts_us").alias("_last"))
    handed = last.select(*FLOW, "_block", F.lag("_last").over(Window.partitionBy(*FLOW).orderBy("_block")).alias("_handed"))
    by = Window.partitionBy(*FLOW, "_block").orderBy("ts_us", "seq")
    gaps = used.withColumn("_before", F.lag("ts_us").over(by)).join(handed, [*FLOW, "_block"])
    return gaps.withColumn("gap_us", F.col("ts_us") - F.coalesce("_before", "_handed")).where("gap_us is not null").select(*FLOW, "gap_us")


def interval_stats(packets: DataFrame, least: int, own: dict | None = None) -> DataFrame:
    """n, mean, stddev, median and median absolute deviation of each flow's gaps, in seconds; with own, of flows whose mean and
    deviation are regular by it."""
    gaps = intervals(packets, least)
    gap = F.col("gap_us") / F.lit(1e6)
    stats = gaps.groupBy(*FLOW).agg(F.count("*").alias("n"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("stddev"))
    if own is not None:
        stats = stats.where((F.col("mean") > 0.001) & (F.col("stddev") / F.col("mean") <= own["max_cov"]))
        gaps = gaps.join(stats.select(*FLOW), FLOW)
    twice = medians(gaps, FLOW, F.col("gap_us"), "_twice")  # the sum of both middle gaps
    away = medians(gaps.join(twice, FLOW), FLOW, F.abs(2 * F.col("gap_us") - F.col("_twice")), "_away")
    out = stats.join(twice, FLOW).join(away, FLOW)
    return out.withColumn("median", F.col("_twice") / F.lit(2e6)).withColumn("mad", F.col("_away") / F.lit(4e6)).drop("_twice", "_away")
