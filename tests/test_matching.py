"""Long lists of patterns and networks against plain loops, and captures written by tasks."""

import ipaddress
import os
import random

import pytest

from flowlens import config
from flowlens.functions.patterns import automaton, first_pattern
from flowlens.functions.prefixes import longest_prefix
from flowlens.operators import detectors as D
from flowlens.sources import carve, pcap
from pyspark.sql import functions as F

from .test_flows_and_detectors import packets
from .test_sources import FRAME, classic, eth, ip4


def test_first_pattern_of_many(spark):
    r = random.Random(5)
    some = lambda n: bytes(r.choice(b"abc\x00\xff") for _ in range(n))
    listed = [some(r.randint(3, 9)) for _ in range(10_000)] + [b"MZ", b"", b"MZ"]
    payloads = [some(r.randint(0, 60)) for _ in range(200)] + [None, b"", b"..MZ..MZ", b"xx"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload binary").repartition(3)
    got = {x["i"]: x["t"] and tuple(x["t"]) for x in df.select("i", first_pattern(F.col("payload"), listed).alias("t")).collect()}
    for i, p in enumerate(payloads):
        want = next(((k, p.find(m)) for k, m in enumerate(listed) if m and m in p), None) if p is not None else None
        assert got[i] == want
    assert df.select(first_pattern(F.col("payload"), []).alias("t")).where("t is not null").count() == 0
    assert len(automaton([b"a", b"a", b"b"])) == 2


def test_listed_signatures_give_what_the_fixed_ones_give(spark):
    bodies = [b"xx%PDF-1MZ", b"7z\xbc\xaf\x27\x1c", b"none here", b"PK\x03\x04", b"y" * 600 + b"MZ", b"MZ"]
    p = packets(spark, *({"payload": b, "src_port": 5000 + i} for i, b in enumerate(bodies)))
    rows = lambda cfg: sorted(map(repr, D.file_magic(p, cfg).collect()))
    assert rows(config.configured()) == rows(config.configured({"file_carver": {"signatures": config.MAGIC}})) != []


def test_longest_prefix_equals_trying_every_network(spark):
    r = random.Random(3)
    four = [f"{r.choice([10, 172, 192])}.{r.randrange(4)}.{r.randrange(4)}.{r.randrange(256)}/{r.randint(0, 32)}" for _ in range(400)]
    six = [f"2001:db8:{r.randrange(3)}::{r.randrange(9):x}/{r.randint(0, 128)}" for _ in range(200)]
    networks = [*four, *six, "nonsense", "10.0.0.0", "10.0.0.0/40", "::/0", None]
    addresses = [f"{r.choice([10, 172, 192, 8])}.{r.randrange(5)}.{r.randrange(5)}.{r.randrange(256)}" for _ in range(150)] + [f"2001:db8:{r.randrange(4)}::{r.randrange(12):x}" for _ in range(60)]
    addresses += ["10.0.0.1"] * 50 + [None, "x", "1.2.3", "::ffff:1.2.3.4"]
    nets = []
    for n in networks:
        try:
            nets.append(ipaddress.ip_network(n, strict=False) if n and "/" in n else None)
        except ValueError:
            nets.append(None)
    df = spark.createDataFrame(list(enumerate(addresses)), "i int, ip string")
    got = {x["i"]: x["prefix_len"] for x in longest_prefix(df, "ip", spark.createDataFrame([(n,) for n in networks], "network string")).collect()}
    for i, text in enumerate(addresses):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            a = None
        assert got[i] == max((n.prefixlen for n in nets if n and a and a.version == n.version and a in n), default=None), text
    assert len(got) == len(addresses)


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_captures_are_written_record_by_record(spark, tmp_path, form):
    many = [eth(0x0800, ip4(17, bytes([0, i % 200, 0, 9, 0, 12, 0, 0]) + b"test")) for i in range(3000)]
    (tmp_path / "a.pcap").write_bytes(classic(many))
    (tmp_path / "b.pcap").write_bytes(classic([FRAME, FRAME[14:]], link=101))
    files = spark.read.format("binaryFile").load([str(tmp_path / n) for n in ("a.pcap", "b.pcap")])
    every = carve.frames(files).select("path", "file_offset")
    named = every.select(F.lit("ALL").alias("alert_id"), "*").unionByName(every.where("file_offset = 24").select(F.lit("ONE").alias("alert_id"), "*"))
    named = named.withColumn("comment", F.concat(F.lit("note of "), "alert_id"))
    carve.write_carved(files, named.unionByName(named), str(tmp_path / "out"), form)
    assert sorted(os.listdir(tmp_path / "out")) == [f"ALL.{form}", f"ONE.{form}"]
    raw = (tmp_path / "out" / f"ALL.{form}").read_bytes()
    rows = list(pcap.records(raw))
    assert [r[6] for r in rows] == [*many, FRAME, FRAME[14:]] and rows[1][1] == 1600000001_500000
    assert len(list(pcap.records((tmp_path / "out" / f"ONE.{form}").read_bytes()))) == 2
    if form == "pcapng":
        assert {r[5] for r in rows} == {1, 101} and raw.count(b"note of ALL") == 3002


def test_a_failed_write_leaves_nothing_behind(spark, tmp_path):
    spark.dataSource.register(carve.CarvedSink)
    rows = [("A", "p", 0, 1, 4, 4, 1, b"good", None), ("B", "p", 1, 1, 4, 4, 1, None, None)]  # the second has no frame
    df = spark.createDataFrame(rows, carve.CarvedSink({}).schema()).repartition(2)
    with pytest.raises(Exception, match="NoneType|WRITE|abort|failed"):
        df.write.format("carved").mode("append").save(str(tmp_path / "out"))
    left = [f for _, _, names in os.walk(tmp_path / "out") for f in names]
    assert left == []
