"""Detectors on streams of packets: alerts once, when the packet that raises them comes.

State is by key and ends `ttl` after its last packet, so it is bounded by the keys of that time; the batch detectors have no
such end. Packets of a batch are taken in the order of seq."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.functions import net
from flowlens.operators import flows

RAISED = "key string, seq long, ts_us long, dst_ip string, dst_port int, targets long"


def first_crossing(rows: DataFrame, key: str, threshold: int, ttl: str = "1 hour") -> DataFrame:
    """For each key the packet at which its number of different `target` first reaches the threshold.

    A key's state holds at most threshold targets, and none once it has been told."""
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told, seen = state.get if state.exists else (False, [])
        seen, out = dict.fromkeys(seen), []
        own = pd.concat(list(frames)).sort_values("seq")
        if not told:
            for r in own.itertuples(index=False):
                seen[r.target] = None
                if len(seen) >= threshold:
                    out.append((names[0], r.seq, r.ts_us, r.dst_ip, r.dst_port, len(seen)))
                    told, seen = True, {}
                    break
        state.update((told, list(seen)))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RAISED.split(", ")])

    slim = rows.select(F.col(key).alias("key"), "seq", "ts_us", "dst_ip", "dst_port", "target")
    return slim.groupBy("key").applyInPandasWithState(step, RAISED, "told boolean, seen array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sweeps(packets: DataFrame, threshold: int = 10, ttl: str = "1 hour") -> DataFrame:
    """Sources that try to open connections to many addresses."""
    syn = (F.col("protocol") == 6) & net.has_bits(F.col("tcp_flags"), 0x02) & ~net.has_bits(F.col("tcp_flags"), 0x10)
    echo = (F.col("protocol") == 1) & (F.col("src_port") == 8)
    rows = packets.where((syn | echo) & (F.col("src_ip") != F.col("dst_ip"))).withColumn("target", F.col("dst_ip"))
    return first_crossing(rows, "src_ip", threshold, ttl)


def flag_anomalies(packets: DataFrame) -> DataFrame:
    """Needs no state."""
    kind = net.flag_anomaly(F.col("tcp_flags"))
    return flows.with_flow(packets).where("protocol = 6").withColumn("anomaly", kind).where("anomaly is not null").select("capture_id", "seq", "ts_us", "flow_id", "src_ip", "dst_ip", "anomaly")


def flow_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Packets and bytes of each flow by time window, with a watermark for late packets."""
    timed = flows.with_flow(packets).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "flow_id").agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))
