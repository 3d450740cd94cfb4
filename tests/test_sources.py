import struct

import pytest

from flowlens.__main__ import main
from flowlens.plans import triage as T
from flowlens.sources import carve, history, pcap, ranges, rules
from flowlens.streaming import detect


def ip4(proto, body, src=b"\x0a\0\0\1", dst=b"\x0a\0\0\2"):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + src + dst + body


def eth(kind, body, tags=b""):
    return b"\0" * 12 + tags + struct.pack(">H", kind) + body


UDP = struct.pack(">HHHH", 1234, 8080, 12, 0) + b"test"
FRAME = eth(0x0800, ip4(17, UDP))
FORMS = {("a1b2c3d4", ">"): 1, ("d4c3b2a1", "<"): 1, ("a1b23c4d", ">"): 1000, ("4d3cb2a1", "<"): 1000}


def classic(frames, form=("a1b2c3d4", ">"), link=1):
    magic, order = form
    head = bytes.fromhex(magic) + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "IIII", 1600000000 + i, 500000 * FORMS[form], len(f), len(f)) + f for i, f in enumerate(frames))


@pytest.mark.parametrize("form", FORMS)
def test_classic_captures(form):
    rows = list(pcap.rows("c", pcap.records(classic([FRAME, FRAME], form) + b"\0" * 7)))
    got = [dict(zip(pcap.COLUMNS, r, strict=True)) for r in rows]
    assert len(got) == 2 and got[1]["ts_us"] == 1600000001_500000
    assert (got[0]["src_ip"], got[0]["dst_ip"], got[0]["src_port"], got[0]["dst_port"], got[0]["protocol"], got[0]["payload"]) == ("10.0.0.1", "10.0.0.2", 1234, 8080, 17, b"test")
    with pytest.raises(ValueError):
        list(pcap.records(b"nonsense"))


def test_link_and_network_kinds():
    tcp = struct.pack(">HHIIHHHH", 5, 6, 1, 2, 0x5012, 0, 0, 0) + b"x"
    assert pcap.decode(eth(0x0800, ip4(6, tcp), b"\x81\0\0\1\x88\xa8\0\2"), 1)["tcp_flags"] == 18
    assert pcap.decode(ip4(17, UDP), 101)["dst_port"] == 8080 and pcap.decode(b"\2\0\0\0" + ip4(17, UDP), 0)["dst_port"] == 8080
    assert pcap.decode(b"\0" * 14 + b"\x08\0" + ip4(17, UDP), 113)["payload"] == b"test"
    six = struct.pack(">IHBB", 0x60000000, 2, 58, 64) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + b"\x80\0"
    assert (pcap.decode(eth(0x86DD, six), 1)["src_ip"], pcap.decode(eth(0x86DD, six), 1)["src_port"]) == ("::1", 128)
    arp = struct.pack(">HHBBH", 1, 0x800, 6, 4, 1) + b"\0" * 6 + b"\x0a\0\0\1" + b"\0" * 6 + b"\x0a\0\0\2"
    assert pcap.decode(eth(0x0806, arp), 1)["protocol"] == 2054
    assert pcap.decode(b"", 1) is None and pcap.decode(eth(0x0800, ip4(6, b"short")), 1) is None


def test_dns_and_tls():
    dns = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\3www\7example\3org\0" + struct.pack(">HH", 16, 1)
    assert pcap.question(dns) == ("www.example.org", 16)
    loop = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c"
    assert pcap.decode(eth(0x0800, ip4(17, struct.pack(">HHHH", 9, 53, 0, 0) + loop)), 1)["decode_error"]
    name = b"\0\0" + struct.pack(">HHBH", 8, 6, 0, 3) + b"a.b"
    exts = name + struct.pack(">HHHH", 10, 4, 2, 29) + struct.pack(">HHBB", 11, 2, 1, 0)
    body = b"\3\3" + b"\0" * 32 + b"\0" + struct.pack(">HHH", 4, 4865, 4866) + b"\1\0" + struct.pack(">H", len(exts)) + exts
    hello = b"\x16\3\1\0\0" + b"\1\0\0\0" + body
    got = pcap.client_hello(hello)
    assert got == {"version": 771, "ciphers": [4865, 4866], "extensions": [0, 10, 11], "supported_groups": [29], "ec_point_formats": [0], "sni": "a.b"}


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def test_pcapng_and_comment_block():
    section = b"\x0a\x0d\x0d\x0a" + struct.pack(">I", 28) + b"\x1a\x2b\x3c\x4d" + struct.pack(">HHq", 1, 0, -1) + struct.pack(">I", 28)
    data = section + block(1, struct.pack(">HHI", 1, 0, 0), ">") + carve.enhanced_block(FRAME, 1_600_000_000_000_001, "note") + block(3, struct.pack(">I", len(FRAME)) + FRAME, ">")
    got = list(pcap.records(data))
    assert [r[1] for r in got] == [1_600_000_000_000_001, 0] and got[0][6] == FRAME == got[1][6]
    one = carve.enhanced_block(FRAME, 1, "note")
    assert one[:4] == b"\0\0\0\6" and b"note" in one and int.from_bytes(one[4:8], "big") == len(one) == int.from_bytes(one[-4:], "big")


def test_spark_readers_carving_and_triage(spark, tmp_path):
    syn = [eth(0x0800, ip4(6, struct.pack(">HHIIHHHH", 5, 80, 1, 0, 0x5002, 0, 0, 0), dst=bytes([10, 0, 1, i]))) for i in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(classic(syn))
    path = str(tmp_path / "in")
    p = pcap.read_captures(spark, path)
    assert p.count() == 12
    spark.dataSource.register(pcap.CaptureSource)
    q = spark.read.format("capture").load(f"{path}/a.pcap")
    assert sorted(q.select("seq", "dst_ip").collect()) == sorted(p.select("seq", "dst_ip").collect())
    run = T.triage(p)
    assert {r["rule_id"] for r in run.alerts.collect()} >= {"RULE-RECON-SWEEP-01", "RULE-TCP-SCAN-01"}
    assert "TRIAGE SUMMARY" in T.text_report(run) and run.summary.first()["total_packets"] == 12
    assert "RULE" not in T.html_report(run) or "<script" not in T.html_report(run)
    files = spark.read.format("binaryFile").load(path)
    named = p.where("seq in (3, 1)").selectExpr("'A' as alert_id", "capture_id as path", "file_offset")
    (row,) = carve.carve(files, named).collect()
    assert [r[6] for r in pcap.records(bytes(row["capture"]))] == [syn[1], syn[3]]
    history.save(run.summary, str(tmp_path / "h"), "one", "2024-01-01")
    assert history.profiles(spark, str(tmp_path / "h")).first()["total_packets"] == 12 and history.get(spark, str(tmp_path / "h"), "one").count() == 1
    with pytest.raises(ValueError):
        history.get(spark, str(tmp_path / "h"), "../x")
    assert history.delete(spark, str(tmp_path / "h"), "one")
    told = detect.sweeps(pcap.stream_captures(spark, path), 10).writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start()
    told.awaitTermination(120)
    batch = run.alerts.where("rule_id = 'RULE-RECON-SWEEP-01'").first()
    assert [tuple(r) for r in spark.table("told").select("key", "seq").collect()] == [("10.0.0.1", batch["seq"])]
    run.close()
    assert main([path, "--carve-all", str(tmp_path / "c"), "--capacity", "3"]) == 0
    carved = {x.name: [r[6] for r in pcap.records(x.read_bytes())] for x in (tmp_path / "c").iterdir()}
    assert carved and all(v == syn[:10] for v in carved.values())


def test_rules():
    text = "a: 1\nb:\n  c: 'x # y'  # note\n  d:\n    - 22\n    - 88\n  e: yes\nf: 0.5\ng:\n"
    assert rules.parse(text) == {"a": 1, "b": {"c": "x # y", "d": [22, 88], "e": True}, "f": 0.5, "g": None}
    assert rules.parse("- 1\n- b") == {"items": [1, "b"]} and rules.parse("") == {}
    with pytest.raises(rules.RulesError, match="line 3"):
        rules.parse("a: 1\nb: 2\nnonsense")


def test_ranges_give_what_whole_files_give(spark, tmp_path):
    """Small ranges, a capture inside a packet, records longer than a range, interface blocks on the way, tails that are cut off."""
    udp = lambda n, body: eth(0x0800, ip4(17, struct.pack(">HHHH", 1000 + n, 8080, 8 + len(body), 0) + body))
    inner = classic([FRAME] * 30)
    frames = [udp(i, b"x" * (i * 7 % 90)) for i in range(120)] + [udp(500, inner), b"none", udp(501, b"y" * 3000)] + [udp(600 + i, b"z") for i in range(40)]
    (tmp_path / "in").mkdir()
    for k, form in enumerate(FORMS):
        (tmp_path / "in" / f"{k}.pcap").write_bytes(classic(frames, form) + b"\0" * (9 * k))
    for k, order in enumerate("<>"):
        section = b"\x0a\x0d\x0d\x0a" + struct.pack(order + "I", 28) + struct.pack(order + "I", 0x1A2B3C4D) + struct.pack(order + "HHq", 1, 0, -1) + struct.pack(order + "I", 28)
        face = lambda link: block(1, struct.pack(order + "HHI", link, 0, 0), order)  # noqa: B023, E731
        packet = lambda f, i: block(6, struct.pack(order + "IIIII", i % 2, 0, 10**9 + i, len(f), len(f)) + f, order)  # noqa: B023, E731
        data = section + face(1) + b"".join(packet(f, 2 * i) for i, f in enumerate(frames)) + face(101) + b"".join(packet(f[14:] if i % 2 else f, i) for i, f in enumerate(frames))
        (tmp_path / "in" / f"n{k}.pcapng").write_bytes(data + section + face(101) + b"".join(packet(f[14:], 2 * i) for i, f in enumerate(frames)) + b"\0" * 30)
    path = str(tmp_path / "in")
    columns = ["capture_id", "seq", "ts_us", "file_offset", "caplen", "src_ip", "src_port", "payload"]
    want = sorted(pcap.read_captures(spark, path).select(columns).collect())
    assert len(want) > 1500 and sorted(ranges.read_ranges(spark, path, 1500).select(columns).collect()) == want


def test_triage_by_ranges_raises_what_whole_files_raise(spark, tmp_path):
    tcp = lambda k: struct.pack(">HHIIBBHHH", 40000 + k, 20 + k, 1, 0, 0x50, 0x29, 1024, 0, 0)
    (tmp_path / "a.pcap").write_bytes(classic([eth(0x0800, ip4(6, tcp(k), dst=bytes([10, 0, 1, k]))) for k in range(60)]))
    whole, parts = (T.triage_path(spark, str(tmp_path / "a.pcap"), range_bytes=n) for n in (None, 700))
    assert parts.packets.count() == 60
    columns = ["alert_id", "rule_id", "source_ip", "target_ip"]
    found = [sorted(map(str, run.alerts.select(columns).collect())) for run in (whole, parts)]
    assert found[0] == found[1] and len(found[0]) > 0
    whole.close(), parts.close()
