"""Flows: packets by their canonical 5-tuple."""

from __future__ import annotations

from collections import Counter, OrderedDict
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import net
from flowlens.tables import cut

BLOCK = 1 << 16


def with_flow(packets: DataFrame) -> DataFrame:
    """packets with flow_id and both ends; as they are where they have them."""
    if {"flow_id", "endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port"} <= set(packets.columns):
        return packets
    c = [F.col(x) for x in ("src_ip", "src_port", "dst_ip", "dst_port")]
    a, b = net.flow_ends(*c)
    ends = {"endpoint_a_ip": a["ip"], "endpoint_a_port": a["port"], "endpoint_b_ip": b["ip"], "endpoint_b_port": b["port"]}
    return packets.withColumns({"flow_id": net.flow_id(*c, F.col("protocol")), **ends})


def aggregate(packets: DataFrame) -> DataFrame:
    """A row for each flow of a capture: counts, bytes, and times in order of arrival."""
    first, last = F.min_by("ts_us", "seq"), F.max_by("ts_us", "seq")
    ends = ["endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port", "protocol"]  # told by flow_id; as keys they leave numbers only to add up, which needs no sort
    out = with_flow(packets).groupBy("capture_id", "flow_id", *ends).agg(
        F.count("*").alias("packet_count"), F.sum("wirelen").alias("byte_count"), first.alias("start_ts_us"), last.alias("last_ts_us"), F.max("seq").alias("last_seq")
    )
    return out.withColumn("duration_sec", F.when(F.col("packet_count") > 1, (F.col("last_ts_us") - F.col("start_ts_us")) / F.lit(1e6)).otherwise(0.0))


def tcp_states(packets: DataFrame) -> DataFrame:
    """Counters and the last state of each TCP flow.

    The state is that of the last packet with SYN, FIN or RST, unless it was a SYN and a packet with ACK came later."""
    f = F.col("tcp_flags")
    syn, ack, fin, rst = (net.has_bits(f, b) for b in (0x02, 0x10, 0x01, 0x04))
    told = F.when(rst, "RESET").when(fin, "FIN_WAIT").when(syn & ack, "SYN_RCVD").when(syn, "SYN_SENT")
    rows = with_flow(packets).where("protocol = 6").withColumn("told", told).withColumn("plain_ack", ~syn & ack)
    count = lambda test, name: F.count_if(test).alias(name)
    out = rows.groupBy("capture_id", "flow_id").agg(
        count(syn, "syn_count"), count(syn & ack, "syn_ack_count"), count(F.col("plain_ack"), "ack_count"), count(fin, "fin_count"), count(rst, "rst_count"),
        F.max_by("told", F.when(F.col("told").isNotNull(), F.col("seq"))).alias("told"), F.max(F.when(F.col("told").isNotNull(), F.col("seq"))).alias("told_at"),
        F.max(F.when(F.col("plain_ack"), F.col("seq"))).alias("acked_at"),
    )
    begun = F.col("told").isin("SYN_SENT", "SYN_RCVD") & (F.col("acked_at") > F.col("told_at"))
    return out.withColumn("tcp_state", F.when(begun, "ESTABLISHED").otherwise(F.coalesce("told", F.lit("CLOSED")))).drop("told", "told_at", "acked_at")


def instances(packets: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """packets with flow_instance: a flow table of this capacity that evicts what was touched longest ago opens a new instance
    where `capacity` other flows or more were touched since the flow's last packet. Each capture has a table of its own.

    Packets are dealt into blocks of about `block` in a row. What the table holds where a block begins are the `capacity` flows
    touched last before it: each block's own are carried forward, twice as far in each round. From there every block is run
    through the table by itself, and openings of a flow in earlier blocks are added up by block. Work grows with packets, and no
    group exceeds a block."""
    capacity = max(capacity, 1)
    rows = with_flow(packets)
    slim = rows.select("capture_id", "seq", "flow_id")
    block = max(block, 4 * capacity)
    n = -(-slim.count() // block)
    if n == 0 or slim.select("flow_id").distinct().count() <= capacity:
        return rows.withColumn("flow_instance", F.lit(0))
    dealt = cut(slim.repartitionByRange(n, "capture_id", "seq").withColumn("block", F.spark_partition_id()))
    n = dealt.agg(F.max("block")).first()[0] + 1
    recent = Window.partitionBy("capture_id", "block").orderBy(F.desc("seq"))

    def latest(touches: DataFrame) -> DataFrame:
        last = touches.groupBy("capture_id", "block", "flow_id").agg(F.max("seq").alias("seq"))
        return last.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= capacity).drop("place")

    held, reach = latest(dealt), 1
    while reach < n - 1:
        on = F.explode(F.array("block", F.col("block") + reach)).alias("block")
        held = cut(latest(held.select("capture_id", on, "flow_id", "seq").where(F.col("block") < n)))
        reach *= 2
    begun = held.select("capture_id", (F.col("block") + 1).alias("block"), "flow_id", "seq", F.lit(True).alias("held"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["held", "seq"], ascending=[False, True])  # what is held comes first, longest ago first
        table, opened, out = OrderedDict(), Counter(), []
        for flow, held in zip(own["flow_id"].tolist(), own["held"].tolist(), strict=True):
            if flow in table:
                table.move_to_end(flow)
            else:
                opened[flow] += not held
                table[flow] = None
                if len(table) > capacity:
                    table.popitem(last=False)
            out.append(opened[flow])
        return own.assign(opened=np.array(out, np.int32))[~own["held"].to_numpy(bool)][["capture_id", "block", "flow_id", "seq", "opened"]]

    kind = ", ".join(f"{c} {t}" for c, t in dealt.dtypes if c in ("capture_id", "seq", "flow_id"))
    parts = dealt.dropDuplicates(["capture_id", "block", "seq", "flow_id"]).withColumn("held", F.lit(False)).unionByName(begun)
    told = cut(parts.groupBy("capture_id", "block").applyInPandas(run, f"block int, opened int, {kind}"))
    blocks = told.groupBy("capture_id", "flow_id", "block").agg(F.max("opened").alias("opens"))
    earlier = Window.partitionBy("capture_id", "flow_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("capture_id", "flow_id", "block", F.coalesce(F.sum("opens").over(earlier), F.lit(0)).alias("before"))

    def joined(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        return a.join(b, reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on))).select("a.*", *(f"b.{c}" for c in right.columns if c not in on))

    found = joined(told, before, "capture_id", "flow_id", "block").withColumn("flow_instance", (F.col("before") + F.col("opened") - 1).cast("int"))
    return joined(rows, found.select("capture_id", "seq", "flow_id", "flow_instance"), "capture_id", "seq", "flow_id")
