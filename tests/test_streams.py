"""Detectors on a stream that is stopped and started again, against the same detectors on the whole table."""

import os

import pytest

from flowlens import config
from flowlens.operators import alerts as A
from flowlens.operators import detectors
from flowlens.operators.beacons import Gaps, Prefix
from flowlens.operators.combinators import medians
from flowlens.streaming import alerts as streamed
from flowlens.streaming import state
from flowlens.tables import cut
from pyspark.sql import functions as F

from .test_flows_and_detectors import packets

SECOND = 1_000_000


def mixed():
    """Packets that every detector has something to say about, each kind spread over the whole capture."""
    kinds = []
    for i in range(16):
        kinds += [
            {"src_ip": "10.0.0.9", "src_port": 4000, "dst_ip": "198.51.100.9", "dst_port": 443, "ts_us": 1_600_000_000 * SECOND + 30 * i * SECOND, "payload": b"x"},
            {"src_ip": "10.0.0.3", "dst_ip": f"10.0.1.{i % 12}", "dst_port": 445, "tcp_flags": 2},
            {"src_ip": "10.0.0.4", "dst_ip": f"10.0.2.{i}", "dst_port": 22, "src_port": 100 + i},
            {"protocol": 17, "tcp_flags": 0, "dst_port": 53, "src_port": 2000 + i % 3, "dns_qname": f"chunk{i}{'abcdefgh' * 4}.tunnel.org", "dns_qtype": 16},
            {"protocol": 17, "tcp_flags": 0, "dst_port": 53, "src_port": 2100 + i % 2, "dns_qname": f"x{i % 3}qzkvbtrpwd8h3j5n.example.com", "dns_qtype": 1},
            {"src_port": 3000 + i % 2, "dst_port": 80, "payload": b"GET /c99.php HTTP/1.1\r\nUser-Agent: curl/8\r\nAuthorization: Basic dXNlcjpwdw==\r\n\r\n"},
            {"src_port": 3100, "dst_port": 445, "payload": b"\\pipe\\svcctl samr lsarpc"},
            {"src_port": 3200 + i % 4, "dst_port": 3389, "payload": b"..MZ.. %PDF-1.7", "tcp_flags": 41 if i % 5 == 0 else 24},
            {"src_port": 3300, "dst_port": 9000, "wirelen": 400_000},
        ]
    return kinds


def test_stream_raises_what_the_batch_raises(spark, monkeypatch):
    cfg = config.configured() | {"stream": {"late": "3650 days", "idle": "1 hour", "ttl": "1 hour"}}
    rows = cut(packets(spark, *mixed()).repartition(2))
    columns = ["rule_id", "alert_id", "capture_id", "key", "seq", "phase", "packet_count", "ts_us", "source_ip", "target_ip", "source_port", "target_port", "proof"]
    want = sorted(map(tuple, A.union(rows, cfg).select(columns).collect()))
    assert len({r[0] for r in want}) >= 12
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = sorted(map(tuple, streamed.replay(rows, cfg, [70]).select(columns).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_state_is_worked_on_by_all_tasks(spark, tmp_path):
    """A report in few files must not draw the work of the state into as few tasks."""
    cfg = config.configured() | {"stream": {"late": "3650 days", "idle": "1 hour", "ttl": "1 hour"}}
    rows = packets(spark, *mixed())
    rows.coalesce(1).write.parquet(f"{tmp_path}/packets")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/packets")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        query = streamed.start(stream, cfg, f"{tmp_path}/alerts", f"{tmp_path}/checkpoint", {k: detectors.DETECTORS[k] for k in ("beacon", "sweep")}, availableNow=True)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]
    assert max(tasks) >= 6  # two operators, three tasks each
    assert {r["rule_id"] for r in spark.read.parquet(f"{tmp_path}/alerts").collect()} == {"RULE-C2-BEACON-01", "RULE-RECON-SWEEP-01"}
    assert len([f for f in os.listdir(f"{tmp_path}/alerts/batch=0") if f.endswith(".parquet")]) == 1


def test_only_events_that_are_asked_for_leave_the_flow_table(spark, tmp_path):
    """Of flows that end, those in which no detector sees anything are not reported."""
    cfg = config.configured() | {"stream": {"late": "3650 days", "idle": "1 hour", "ttl": "1 hour"}}
    rows = packets(spark, *mixed())
    watch = state.Watch()
    A.union(rows, cfg | {"watch": watch}, {"exfil_volume": detectors.DETECTORS["exfil_volume"]})
    event = spark.createDataFrame([(None, None, "closed", 1, 0, None, 0, None, 0, 6, 1, size, 0, dns, False) for size, dns in ((9_000_000, False), (9_000_000, True), (10, False))], state.EVENT.split(", n long")[0])
    watch.flows = event.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in state.STATS.split(", ")))
    assert watch.stream("1 hour", "1 hour").count() == 1


class Memory:
    """Map state as a dictionary."""

    def __init__(self):
        self.names = {}

    def containsKey(self, key):
        return key in self.names

    def updateValue(self, key, value):
        self.names[key] = value

    def keys(self):
        return iter(self.names)

    def exists(self):
        return bool(self.names)

    def clear(self):
        self.names = {}


@pytest.mark.parametrize("size", [1, 3, 100])
def test_a_crossing_does_not_depend_on_how_rows_are_batched(size):
    rows = [(i, {"target": f"t{i * i % 7}", "ip": f"10.0.0.{i % 5}", "port": i % 3}) for i in range(40)]
    step, seen, memory, told = state.Crossing(4), state.Seen(Memory()), None, []
    for k in range(0, len(rows), size):
        memory, out = step.step(memory, seen, rows[k : k + size])
        told += [(k + place, more) for place, more in out]
    assert told == [(3, {"n": 4, "targets": 4, "ips": ["10.0.0.0", "10.0.0.1", "10.0.0.2", "10.0.0.3"], "ports": [0, 1, 2]})]
    assert memory["told"] and not seen.all()


class Group:
    """State of a group as Spark hands it out."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.watermark, self.end = None, False, False, 0, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutTimestamp(self, end):
        assert end > self.watermark
        self.end = end

    def getCurrentWatermarkMs(self):
        return self.watermark


@pytest.mark.parametrize("size", [1, 4, 100])
def test_a_bucket_of_flows_is_one_value_of_state(size):
    import pandas as pd

    rows = [{"flow_id": f"f{i % 3}", "seq": i, "ts_us": (1_600_000_000 + i // 3 * (30 if i % 3 == 0 else 7 ** (i // 3 % 4))) * SECOND, "wirelen": 10 + i, "full": False, "dns": i == 4, "protocol": 6, "src_ip": "a", "src_port": i % 3, "dst_ip": "b", "dst_port": 80} for i in range(42)]
    table, group, told = state.FlowTable(config.DEFAULTS["beacon"], "1 hour"), Group(), []
    run = lambda frame: [r for f in table.step(("c", 0), iter([frame]), group) for r in f.itertuples()]
    for k in range(0, len(rows), size):
        told += run(pd.DataFrame(rows[k : k + size]))
    group.hasTimedOut, group.watermark = True, 1_700_000_000_000
    told += run(pd.DataFrame(rows[:0]))
    assert [(r.flow_id, r.event, r.packet_count) for r in told] == [("f0", "prefix", 12), *((f"f{i}", "closed", 14) for i in range(3))]
    assert [(r.byte_count, r.dns, r.told) for r in told[1:]] == [(sum(10 + i for i in range(k, 42, 3)), k == 1, k == 0) for k in range(3)]
    assert not group.exists


def test_medians_by_blocks_are_exact(spark):
    import random
    import statistics

    r = random.Random(1)
    values = [("hot", r.randrange(1000)) for _ in range(3000)] + [("one", 7)] + [("even", v) for v in (1, 2, 4, 9)] + [("same", 5)] * 900
    got = {x["k"]: x["twice"] for x in medians(spark.createDataFrame(values, "k string, v long"), ["k"], F.col("v"), "twice").collect()}
    assert got == {k: int(2 * statistics.median([v for n, v in values if n == k])) for k in {k for k, _ in values}}


def test_gaps_of_a_prefix():
    g = Gaps()
    for t in (0, 10, 30, 20):
        g.add(t * SECOND)
    assert g.gaps == [10 * SECOND] * 3 and g.spread() == (10.0, 0.0) and g.middle() == (10.0, 0.0)
    own = config.DEFAULTS["beacon"]
    p = Prefix(own, [(i * 5 * SECOND, False) for i in range(11)])
    assert p.add(55 * SECOND, False)[0] == 11 and Prefix(own, [(0, True)] * 3).whole() is None
