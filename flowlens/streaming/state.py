"""What detectors keep by key on streams, in place of the aggregates and windows of batches.

A detector asks for rows that depend on earlier ones through first_rows(), crossed(), tunnels(), unseen() and flow_events(). While a
stream's plan is made, a Watch takes down what each asks; all of it becomes one stateful operator (Keyed), and the flow table (FlowTable)
another, whatever the number of detectors. Micro-batch by micro-batch the same calls then give the rows that state let through.

A micro-batch's packets of one key are taken in order of seq, so a stream that brings packets in their order raises what the batch
raises. State of keys ends a time to live after their last packet, and flows close, by timers on event time. Packets beyond the
watermark are dropped by Spark. Rows pass through state as JSON, without their payload."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPTURE = "capture_id"
DEFAULTS = {"ttl": "7 days", "idle": "1 hour", "late": "10 minutes", "buckets": 1024}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLOW = "seq long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, packet_count long, byte_count long, start_ts_us long"
STATS = "n long, mean double, stddev double, median double, mad double"
EVENT = f"capture_id string, flow_id string, event string, {FLOW}, dns boolean, told boolean, {STATS}"


def millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def setting(cfg: dict | None, name: str) -> str:
    return (cfg or {}).get("stream", {}).get(name, DEFAULTS[name])


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")


class Seen:
    """Names that a key has seen, one entry of map state each."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, name: str) -> bool:
        return self.state.containsKey((name,))

    def add(self, name: str, seq: int) -> None:
        self.state.updateValue((name,), (seq,))

    def all(self) -> set[str]:
        return {k[0] for k in self.state.keys()} if self.state.exists() else set()

    def clear(self) -> None:
        self.state.clear()


#: A step of a key takes what it remembers (None at first), what it has seen and its rows (seq, args); it returns what to remember and
#: the rows let through, by their place, with what is added to them.
Step = tuple[dict, list[tuple[int, dict]]]


class First:
    """The first row of each key."""

    def step(self, memory: dict | None, seen: Seen, rows: list[tuple[int, dict]]) -> Step:
        return {}, ([(0, {})] if memory is None else [])


class Crossing:
    """The row at which a key's number of different targets first reaches the threshold, with n (rows so far), targets (their
    number), ips and ports (different values so far, ascending). A key has at most threshold targets and 65,536 ports in its state,
    and none once it has been told."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def step(self, memory: dict | None, seen: Seen, rows: list[tuple[int, dict]]) -> Step:
        memory = memory or {"n": 0, "told": False}
        if memory["told"]:
            return memory, []
        known, n = seen.all(), memory["n"]
        before = set(known)
        of = lambda kind: [x[len(kind) + 1 :] for x in known if x.startswith(kind + "|")]
        targets = len(of("target"))
        for place, (_, args) in enumerate(rows):
            n, new = n + 1, f"target|{args['target']}" not in known
            known |= {f"target|{args['target']}", f"ip|{args['ip']}", f"port|{args['port']}"}
            targets += new
            if targets >= self.threshold:
                seen.clear()
                return {"n": n, "told": True}, [(place, {"n": n, "targets": targets, "ips": sorted(of("ip")), "ports": sorted(map(int, of("port")))})]
        for name in known - before:
            seen.add(name, rows[-1][0])
        return {"n": n, "told": False}, []


class Tunnel:
    """The query at which those for names below a parent are first enough and long enough, with the numbers so far."""

    def __init__(self, queries: int, length: float):
        self.queries, self.length = queries, length

    def step(self, memory: dict | None, seen: Seen, rows: list[tuple[int, dict]]) -> Step:
        m = memory or {"n": 0, "chars": 0, "odd": 0, "samples": [], "first": None, "told": False}
        for place, (_, args) in enumerate(rows if not m["told"] else []):
            m["n"], m["chars"], m["odd"], m["first"] = m["n"] + 1, m["chars"] + args["chars"], m["odd"] + args["odd"], m["first"] or args["first"]
            if len(m["samples"]) < 5 and args["sub"] not in m["samples"]:
                m["samples"].append(args["sub"])
            if m["n"] >= self.queries and m["chars"] / m["n"] >= self.length:
                return m | {"told": True}, [(place, {k: m[k] for k in ("n", "chars", "odd", "samples", "first")})]
        return m, []


class Unseen:
    """Each row that has a name which its key has not reported before, with the first such name."""

    def step(self, memory: dict | None, seen: Seen, rows: list[tuple[int, dict]]) -> Step:
        out = []
        for place, (seq, args) in enumerate(rows):
            if (new := next((x for x in args["names"] if x not in seen), None)) is not None:
                seen.add(new, seq)
                out.append((place, {"name": new}))
        return {}, out


class Keyed(StatefulProcessor):
    """All steps by their number (kind)."""

    def __init__(self, steps: dict, ttl: str):
        self.steps, self.ttl = steps, millis(ttl)

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "json string, last long")
        self.seen = Seen(handle.getMapState("seen", "name string", "seq long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = in_order(rows)
        line, last = self.memory.get() or (None, 0)
        if not last:
            self.handle.registerTimer(int(own["ts_us"].max()) // 1000 + self.ttl)
        memory, told = self.steps[int(key[0])].step(line and json.loads(line), self.seen, list(zip(own["seq"].tolist(), map(json.loads, own["args"]), strict=True)))
        self.memory.update((json.dumps(memory), max(last, int(own["ts_us"].max()))))
        lines = own["row"].tolist()
        yield pd.DataFrame([(int(key[0]), lines[place], json.dumps(more)) for place, more in told], columns=["kind", "row", "more"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The end of a key's state, unless it has changed since: then that time and ttl more."""
        _, last = self.memory.get() or (None, 0)
        if last // 1000 + self.ttl > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(last // 1000 + self.ttl)
        else:
            self.memory.clear()
            self.seen.clear()
        yield pd.DataFrame({"kind": pd.Series([], dtype="int32"), "row": pd.Series([], dtype=str), "more": pd.Series([], dtype=str)})


FLOW_KIND = -1


class Watch:
    """What detectors ask of state: taken down while `told` is None, else given from it (kind, row, more), a micro-batch's rows."""

    def __init__(self, told: DataFrame | None = None):
        self.told, self.parts, self.steps, self.kinds, self.flows, self.wanted = told, [], {}, 0, None, []

    def rows(self, df: DataFrame, keys: list[str], step, more: str = "", args: list | None = None) -> DataFrame:
        """Rows of df that the step lets through (None: all), without their payload, with the columns that it adds (more)."""
        kind, added = self.kinds, [c.split()[0] for c in more.split(", ")] if more else []
        self.kinds += 1
        kept = [c for c in df.columns if c != "payload" and c not in added]
        form = df.select(*kept).schema
        if self.told is not None:
            own = self.told.where(F.col("kind") == kind).select(F.from_json("row", form).alias("_row"), F.from_json("more", more or "_ string").alias("_more"))
            return own.select("_row.*", *(F.col(f"_more.{c}").alias(c) for c in added))
        key = F.to_json(F.struct(CAPTURE, *keys)).alias("key")
        self.parts.append((df.select(F.lit(kind).alias("kind"), key, "seq", "ts_us", F.timestamp_micros("ts_us").alias("ts"), F.to_json(F.struct(*kept)).alias("row"), F.to_json(F.struct(F.lit(0).alias("_"), *(args or []))).alias("args")), step))
        if step is not None:
            self.steps[kind] = step
        out = df.sparkSession.createDataFrame([], form)
        return out.select("*", *(F.lit(None).cast(c.split(maxsplit=1)[1]).alias(c.split()[0]) for c in (more.split(", ") if more else [])))

    def stream(self, ttl: str, late: str) -> DataFrame:
        """kind, row and more of all that was asked."""
        keyed = [part for part, step in self.parts if step is not None]
        out = [part.select("kind", "row", F.lit("{}").alias("more")) for part, step in self.parts if step is None]
        if keyed:
            every = keyed[0]
            for part in keyed[1:]:
                every = every.unionByName(part)
            out.append(every.withWatermark("ts", late).groupBy("kind", "key").transformWithStateInPandas(Keyed(self.steps, ttl), "kind int, row string, more string", "Append", "EventTime"))
        if self.flows is not None:  # most flows end without anything to say
            events = self.flows.where(reduce(or_, self.wanted))
            out.append(events.select(F.lit(FLOW_KIND).alias("kind"), F.to_json(F.struct("*")).alias("row"), F.lit("{}").alias("more")))
        told = out[0]
        for part in out[1:]:
            told = told.unionByName(part)
        return told


def watching(cfg: dict | None) -> Watch | None:
    return (cfg or {}).get("watch")


class FlowTable:
    """The flow table: a flow opens with a packet, closes `idle` after its last one, and may open again. An event is told when a flow's
    gaps are regular for the first time (beacon: "prefix"), and when it closes ("closed"), with its numbers and those of its gaps.

    Flows are dealt to buckets by the hash of their id, and a bucket's flows are one value of state, which a micro-batch reads and
    writes once: a call for each flow costs far more than its packets. Times are kept until the gaps have been found regular; nothing
    else grows with a flow."""

    def __init__(self, own: dict, idle: str):
        self.own, self.idle = own, millis(idle)
        self.numbers = [c.split()[0] for c in FLOW.split(", ")]
        self.columns = [c.split()[0] for c in EVENT.split(", ")]

    def _event(self, capture: str, flow: str, event: str, state: dict, stats: tuple | None) -> tuple:
        return (capture, flow, event, *(state[n] for n in self.numbers), state["dns"], state["told"], *(stats or (None,) * 5))

    def _take(self, capture: str, flow: str, state: dict | None, rows: list) -> tuple[dict, list[tuple]]:
        """A flow after its packets, in order, and what they tell."""
        from flowlens.operators.beacons import Prefix

        out = []
        prefix = None if state and state["told"] else Prefix(self.own, state["times"] if state else [])
        for r in rows:
            if state is None:
                state = {"packet_count": 0, "byte_count": 0, "start_ts_us": int(r.ts_us), "dns": False, "told": False, "times": [], "src_ip": r.src_ip, "src_port": int(r.src_port), "dst_ip": r.dst_ip, "dst_port": int(r.dst_port), "protocol": int(r.protocol)}
            state |= {"seq": int(r.seq), "ts_us": int(r.ts_us), "packet_count": state["packet_count"] + 1, "byte_count": state["byte_count"] + int(r.wirelen), "dns": state["dns"] or bool(r.dns)}
            if prefix is not None:
                state["times"].append((int(r.ts_us), bool(r.full)))
                if (stats := prefix.add(int(r.ts_us), bool(r.full))) is not None:
                    state |= {"told": True, "times": []}
                    prefix = None
                    out.append(self._event(capture, flow, "prefix", state, stats))
        return state, out

    def _closed(self, capture: str, flow: str, state: dict) -> tuple:
        from flowlens.operators.beacons import Prefix

        judged = not state["told"] and state["packet_count"] >= self.own["min_samples"]
        return self._event(capture, flow, "closed", state, Prefix(self.own, state["times"]).whole() if judged else None)

    def step(self, key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        """A bucket's packets, then the flows whose time is over."""
        capture, table, told = key[0], json.loads(group.get[0]) if group.exists else {}, []
        if not group.hasTimedOut:
            fresh: dict[str, list] = {}
            for r in in_order(frames).itertuples(index=False):
                fresh.setdefault(r.flow_id, []).append(r)
            for flow, rows in fresh.items():
                table[flow], out = self._take(capture, flow, table.get(flow), rows)
                told += out
        now, ends = group.getCurrentWatermarkMs(), {flow: state["ts_us"] // 1000 + self.idle for flow, state in table.items()}
        for flow in [flow for flow, end in ends.items() if end <= now]:
            told.append(self._closed(capture, flow, table.pop(flow)))
            del ends[flow]
        if table:
            group.update((json.dumps(table),))
            group.setTimeoutTimestamp(min(ends.values()))
        elif group.exists:
            group.remove()
        if told:
            yield pd.DataFrame(told, columns=self.columns).astype({"n": "Int64"})


def first_rows(df: DataFrame, keys: list[str], watch: Watch) -> DataFrame:
    return watch.rows(df, keys, First())


def crossed(df: DataFrame, key: str, targets: list[str], threshold: int, watch: Watch) -> DataFrame:
    target = F.concat_ws("|", *(F.col(t).cast("string") for t in targets)).alias("target")
    return watch.rows(df, [key], Crossing(threshold), "n long, targets long, ips array<string>, ports array<int>", [target, F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")])


def tunnels(rows: DataFrame, queries: int, length: float, watch: Watch) -> DataFrame:
    """rows (parent, sub, is_odd) at the first that passes, with n, chars, odd, samples, and first, the ends of the first query."""
    args = [F.length("sub").alias("chars"), F.col("is_odd").cast("long").alias("odd"), F.col("sub"), F.struct("src_ip", "dst_ip").alias("first")]
    return watch.rows(rows, ["parent"], Tunnel(queries, length), "n long, chars long, odd long, samples array<string>, first struct<src_ip:string,dst_ip:string>", args)


def unseen(rows: DataFrame, pair: list[str], watch: Watch) -> DataFrame:
    """rows (keys) at each first of a key's names, with name."""
    return watch.rows(rows, pair, Unseen(), "name string", [F.col("keys").alias("names")]).drop("keys")


def flow_events(packets: DataFrame, cfg: dict, wanted: Column) -> DataFrame:
    """Events of the flow table over packets with flows that the caller wants, a condition on them: capture_id, flow_id, event, numbers
    of the flow, dns (it has a query that tells exfiltration), told (its gaps were regular before) and numbers of regular gaps, else
    null. src is endpoint a."""
    watch, form = watching(cfg), EVENT
    if watch.told is not None:
        return watch.told.where(F.col("kind") == FLOW_KIND).select(F.from_json("row", form).alias("_row")).select("_row.*").where(wanted)
    watch.wanted.append(wanted)
    if watch.flows is None:
        dns = F.coalesce((F.col("dns_qname") != "") & ((F.col("dns_qtype") == 16) | (F.length("dns_qname") > 64)), F.lit(False))
        ends = [F.col(f"endpoint_{a}_{b}").alias(f"{c}_{b}") for a, c in (("a", "src"), ("b", "dst")) for b in ("ip", "port")]
        bucket = F.pmod(F.xxhash64("flow_id"), F.lit(int(setting(cfg, "buckets")))).alias("bucket")
        slim = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", setting(cfg, "late"))
        slim = slim.select(CAPTURE, bucket, "flow_id", "ts", "seq", "ts_us", "wirelen", (F.col("payload_len") > 0).alias("full"), "protocol", dns.alias("dns"), *ends)
        table = FlowTable(cfg["beacon"], setting(cfg, "idle"))
        watch.flows = slim.groupBy(CAPTURE, "bucket").applyInPandasWithState(table.step, form, "flows string", "append", GroupStateTimeout.EventTimeTimeout)
    return packets.sparkSession.createDataFrame([], form)
