import hashlib
import json
import random
import statistics

import pytest

from flowlens import config, schemas
from flowlens.functions import net
from flowlens.operators import alerts as A
from flowlens.operators import detectors as D
from flowlens.operators import flows
from flowlens.operators.combinators import running
from flowlens.plans import queries
from flowlens.plans.triage import stix_bundle, text_report, triage
from pyspark.sql import functions as F

BASE = {"capture_id": "c", "caplen": 60, "wirelen": 60, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1234, "dst_port": 80, "protocol": 6, "tcp_seq": 0, "tcp_ack": 0, "tcp_flags": 24, "dns_qname": None, "dns_qtype": None, "tls_info": None, "payload": None, "payload_len": 0, "decode_error": None}


def packets(spark, *rows):
    order = [f.name for f in spark.createDataFrame([], schemas.PACKETS).schema]
    full = [BASE | {"seq": i, "ts_us": 1_600_000_000_000_000 + i * 1_000_000, "file_offset": 24 + 76 * i} | r for i, r in enumerate(rows)]
    for r in full:
        if r["payload"]:
            r["payload_len"] = len(r["payload"])
    return spark.createDataFrame([tuple(r[c] for c in order) for r in full], schemas.PACKETS)


def cfg(**sections):
    return config.configured(sections)


def test_flow_key_is_symmetric(spark):
    p = packets(spark, {}, {"src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 1234})
    assert [r["flow_id"] for r in flows.with_flow(p).select("flow_id").distinct().collect()] == ["6:10.0.0.1:1234<->10.0.0.2:80"]


def test_capacity_of_two_evicts_the_oldest(spark):
    p = packets(spark, *({"src_port": x} for x in (1, 2, 3, 1)))
    got = {(r["src_port"], r["seq"]): r["flow_instance"] for r in flows.instances(p, 2).collect()}
    assert got == {(1, 0): 0, (2, 1): 0, (3, 2): 0, (1, 3): 1}
    assert flows.instances(p, 5).agg(F.max("flow_instance")).first()[0] == 0


@pytest.mark.parametrize("capacity, block", [(1, 8), (3, 16), (5, 20), (3, 1 << 16)])
def test_instances_equal_a_table_run_packet_by_packet(spark, capacity, block):
    # one flow has a third of the packets, one comes back after many blocks, and seqs of two captures clash
    rows, want = [], {}
    for c in ("c", "d"):
        table, count = [], {}
        for i in range(160):
            port = 1 if i % 3 == 0 else 99 if i in (1, 158) else 2 + (i * i + len(c + c) * (c == "d")) % 11
            rows.append({"capture_id": c, "seq": i, "src_port": port})
            if port in table:
                table.remove(port)
            else:
                count[port] = count.get(port, -1) + 1
            table = [*table, port][-capacity:]
            want[c, i] = (port, count[port])
    got = flows.instances(packets(spark, *rows), capacity, block).collect()
    assert len(got) == len(rows) and {(r["capture_id"], r["seq"]): (r["src_port"], r["flow_instance"]) for r in got} == want
    assert max(n for _, n in want.values()) > 1


def test_query_of_instances_covers_every_packet(spark, tmp_path):
    kinds = ("signup", "click", "view", "error", "purchase")
    events = [(i, f"2024-01-01 00:00:{i % 60:02}", i % 30, kinds[i % 5], 1.0, f'{{"k": {i % 20}}}') for i in range(2900, 3100)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert queries.flow_instances(spark, str(tmp_path)).agg(F.sum("packets")).first()[0] == 200


def test_query_of_requests_takes_payloads_only(spark, tmp_path):
    # users 6976 and 7056 send from ports 8000 and 8080, DNS queries too
    events = [(i, f"2024-01-01 00:00:0{i}", u, kind, 1.0, '{"k": 1}') for i, (u, kind) in enumerate([(6976, "signup"), (7056, "signup"), (6976, "purchase"), (5, "purchase"), (7056, "view")])]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["seq"] for r in queries.http_parse(spark, str(tmp_path)).collect()) == [2, 3]


def test_alerts_share_one_table_of_packets_and_make_no_more_than_is_asked(spark, tmp_path):
    kinds = ("signup", "click", "view", "error", "purchase")
    events = [(i, f"2024-01-01 00:00:{i % 60:02}", i % 30, kinds[i % 5], 1.0, f'{{"k": {i % 20}}}') for i in range(60)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    counts = queries.severity_counts(spark, str(tmp_path))
    assert not [f for f in counts.inputFiles() if "events.parquet" in f]
    assert "to_json" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_packets_meet_alerts_scope_by_scope(spark):
    met = A.bridge(A.empty(spark), packets(spark, {}))
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert {"alert_id", "at", "packet_src_ip", "scope", "scope_key"} <= set(met.columns)


@pytest.mark.parametrize("flags, state", [([2], "SYN_SENT"), ([2, 18], "SYN_RCVD"), ([2, 18, 16], "ESTABLISHED"), ([2, 18, 16, 17], "FIN_WAIT"), ([4], "RESET"), ([16], "CLOSED")])
def test_tcp_state(spark, flags, state):
    assert flows.tcp_states(packets(spark, *({"tcp_flags": f} for f in flags))).first()["tcp_state"] == state


def test_beacon(spark):
    p = packets(spark, *({} for _ in range(10)))
    rules = cfg(beacon={"min_samples": 5, "min_duration_sec": 1.0})
    row = D.beacon(p, rules).first()
    assert row["rule_id"] == "RULE-C2-BEACON-01" and row["proof"]["cov_calculated"] == 0.0
    first = D.beacon_prefix(p, rules).collect()
    assert len(first) == 1 and first[0]["packet_count"] == 5


def test_dns_names(spark):
    names = ["_ldap._tcp.dc._msdcs.corp.internal", "_kerberos._tcp.dc._msdcs.domain.local", "_kpasswd._udp.dc.site._sites.corp.lan", "1.0.0.10.in-addr.arpa", "telemetry.microsoft.com", "www.msftncsi.com", "clients6.google.com"]
    p = packets(spark, *({"protocol": 17, "dst_port": 53, "dns_qname": n, "dns_qtype": 1} for n in names))
    assert D.dga(p, cfg(entropy={"entropy_threshold": 0.0, "min_subdomain_len": 1})).count() == 0
    q = packets(spark, {"protocol": 17, "dns_qname": "cxz98a7sdf6.eval.example.com", "dns_qtype": 1}, {"protocol": 17, "dns_qname": "x89q2k4l91m.malicious-c2.net", "dns_qtype": 1})
    assert D.dga(q, cfg(entropy={"entropy_threshold": 3.0, "min_subdomain_len": 5})).count() == 2
    one = spark.range(1).select(net.entropy(F.lit("cxz98a7sdf6qwerty")).alias("h"), net.entropy(F.lit("")).alias("e"), net.consonant_run(F.lit("abcdfge")).alias("r")).first()
    assert one["h"] > 3.5 and one["e"] == 0.0 and one["r"] == 5


def test_tunnel(spark):
    p = packets(spark, *({"protocol": 17, "dns_qname": f"sub{i}.verylongencodedpayloadchunk{i * 1000}.covert-tunnel.org", "dns_qtype": 16} for i in range(10)))
    rows = D.dns_tunnel(p, cfg()).collect()
    assert len(rows) == 1 and rows[0]["proof"]["total_queries_received"] == 8


def test_scans(spark):
    assert [r["proof"]["anomaly_classification"] for r in D.flag_anomalies(packets(spark, {"tcp_flags": 0}, {"tcp_flags": 41}, {"tcp_flags": 1}, {"tcp_flags": 19}, {"tcp_flags": 24}), cfg()).orderBy("seq").collect()] == ["NULL scan", "XMAS scan", "FIN scan", "SYN-FIN"]
    scan = D.syn_scan(packets(spark, *({"dst_port": 1000 + i, "tcp_flags": 2} for i in range(5))), cfg(tcpstate={"syn_scan_threshold": 3})).collect()
    assert len(scan) == 1 and scan[0]["seq"] == 2
    hosts = packets(spark, *({"src_ip": "10.0.0.100", "dst_ip": f"10.0.0.{i}", "dst_port": 445, "tcp_flags": 2} for i in (1, 1, 2, 3, 4)))
    sweep = D.subnet_sweep(hosts, cfg(sweep={"sweep_threshold": 3})).collect()
    assert len(sweep) == 1 and (sweep[0]["seq"], sweep[0]["packet_count"]) == (3, 4)
    assert D.lateral(hosts, cfg(lateral={"fanout_threshold": 3})).count() == 1
    assert D.lateral(hosts.withColumn("src_ip", F.lit("8.8.8.8")), cfg(lateral={"fanout_threshold": 3})).count() == 0


def test_http_and_credentials(spark):
    text = lambda s: {"payload": s.encode()}
    p = packets(spark, text("GET /index.php HTTP/1.1\r\nUser-Agent: python-requests/2.28.1\r\n\r\n"), text("GET /uploads/c99.php?cmd=id HTTP/1.1\r\n\r\n") | {"src_port": 7}, text("PUT /a HTTP/1.1\r\n\r\n") | {"src_port": 8}, text("nothing") | {"src_port": 9})
    assert {r["rule_id"] for r in D.http_audit(p, cfg()).collect()} == {"RULE-HTTP-USERAGENT-01", "RULE-HTTP-WEBSHELL-01", "RULE-HTTP-METHOD-01"}
    c = D.credentials(packets(spark, text("POST /login HTTP/1.1\r\nAuthorization: Basic dXNlcjpwYXNzMTIz\r\n\r\n"), text("USER bob\r\n") | {"dst_port": 21}, text("AUTH PLAIN AGFubgBzZWNyZXQ=") | {"dst_port": 25}), cfg())
    assert {r["proof"]["extracted_user"] for r in c.collect()} == {"user", "bob", "ann"}


def test_volume_tls_files_and_smb(spark):
    assert D.exfil_volume(packets(spark, {"wirelen": 5000}), cfg(exfil={"min_exfil_bytes": 1000})).count() == 1
    tls = {"version": 771, "ciphers": [4865, 4866, 4867], "extensions": [0, 23, 65281], "supported_groups": [29, 23], "ec_point_formats": [0], "sni": "a.b"}
    p = packets(spark, {"tls_info": tuple(tls.values()), "dst_port": 443})
    text = "771,4865-4866-4867,0-23-65281,29-23,0"
    hello = D.tls_hellos(p).first()
    assert hello["ja3"] == text and hello["ja4"].startswith("t12d030300_")
    assert D.ja3(p, cfg() | {"ja3_intel": [(hashlib.md5(text.encode()).hexdigest(), "m")]}).first()["severity"] == "CRITICAL"
    magic = D.file_magic(packets(spark, {"payload": b"..MZ\x90\x00\x03"}, {"payload": b"MZ\x90\x00", "dst_port": 443}), cfg()).collect()
    assert len(magic) == 1 and magic[0]["severity"] == "HIGH" and magic[0]["proof"]["payload_offset"] == 2
    smb = packets(spark, *({"payload": rb"\xfeSMB\pipe\svcctl samr", "dst_port": 445} for _ in range(4)), {"payload": b"\\\\C$", "dst_port": 445})
    assert [r["proof"]["resource"] for r in D.smb_audit(smb, cfg()).orderBy("seq").collect()] == ["svcctl", "samr", "c$"]


def test_alerts_are_deduplicated_and_correlated(spark):
    rows = [(f"A{i}", rule, "t", "d", "HIGH", stage, "10.0.0.1", "", 1, 2, "TCP", ts, "f", 1, "{}", "d", "c", "k", i, 0, 0, "packet", str(i)) for i, (rule, stage, ts) in enumerate([("R1", "Reconnaissance", 0), ("R2", "Lateral Movement", 100), ("R3", "Command & Control", 200)])]
    alerts = spark.createDataFrame([*rows, rows[0][:18] + (9, 0, 0, "packet", "9")], A.empty(spark).schema)
    one = A.dedup(alerts)
    assert one.count() == 3 and one.where("alert_id = 'A0'").select("seq", "place.seq").first()[:] == (9, 0)
    top = A.timelines(one).first()
    assert (top["entity_ip"], top["plausibility_score"], top["chronological_alignment"]) == ("10.0.0.1", 76.0, "High")
    assert {r["severity"]: r["alerts"] for r in A.severity_counts(one).collect()} == {"CRITICAL": 0, "HIGH": 3, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert A.stix_objects(one).count() == 9 and A.search(one, "HIGH", "a1").count() == 1
    assert A.timelines(A.empty(spark)).count() == 0


def test_captures_of_a_folder_are_judged_by_themselves(spark):
    hosts = [{"src_ip": "10.0.0.9", "dst_ip": f"10.0.0.{20 + i}", "src_port": 1000 + i, "tcp_flags": 2, "capture_id": c, "seq": i} for c in ("a.pcap", "b.pcap") for i in range(12)]
    p = packets(spark, *hosts)
    sweeps = A.dedup(A.union(p, cfg(), {"sweep": D.subnet_sweep})).collect()
    assert sorted((r["capture_id"], r["packet_count"]) for r in sweeps) == [("a.pcap", 10), ("b.pcap", 10)]
    assert flows.aggregate(p).where("packet_count = 1").count() == 24
    beacons = packets(spark, *({"capture_id": c, "seq": i, "ts_us": 10**15 + i * 10**6} for c in ("a", "b") for i in range(7)))
    assert D.beacon(beacons, cfg(beacon={"min_samples": 8})).count() == 0 and D.beacon(beacons, cfg(beacon={"min_samples": 6})).count() == 2


def test_alerts_refer_to_the_packets_that_raised_them(spark):
    syn = {"tcp_flags": 2, "src_ip": "10.0.0.9"}
    rows = [syn | {"dst_ip": f"10.0.0.{20 + i}", "dst_port": 80} for i in range(4)] + [{"payload": b"plain"}, {"payload": b"MZ\x90\x00"}, {"payload": b"more"}]
    rows += [{"protocol": 17, "dst_port": 53, "src_port": 40 + i, "dns_qname": f"sub{i}.verylongencodedpayloadchunk{i * 1000}.covert-tunnel.org", "dns_qtype": 16} for i in range(10)]
    p, rules = packets(spark, *rows), cfg(sweep={"sweep_threshold": 3})
    alerts = A.dedup(A.union(p, rules, {k: D.DETECTORS[k] for k in ("sweep", "file_magic", "dns_tunnel")}))
    got = {r["rule_id"]: r["at"] for r in A.evidence(alerts, p, rules).join(alerts.select("alert_id", "rule_id"), "alert_id").groupBy("rule_id").agg(F.sort_array(F.collect_list("seq")).alias("at")).collect()}
    assert got == {"RULE-RECON-SWEEP-01": [0, 1, 2], "RULE-FILE-MAGIC-01": [5], "RULE-DNS-TUNNEL-01": list(range(7, 15))}
    told = {r["domain"]: (r["count"], r["qtype"], r["threat_status"]) for r in A.dns_telemetry(alerts, p, rules).collect()}
    assert len(told) == 8 and told[rows[14]["dns_qname"]] == (1, "TXT", "COVERT DNS TUNNELING") and {v[2] for k, v in told.items() if k != rows[14]["dns_qname"]} == {"BENIGN"}
    (tunnel,) = D.dns_tunnel(p, rules).collect()
    assert tunnel["proof"]["sample_subdomains"] == [r["dns_qname"].rsplit(".", 2)[0] for r in rows[7:12]]


@pytest.mark.parametrize("section, detector, row", [("dns_tunnel", "dns_tunnel", None), ("file_carver", "file_magic", {"payload": b"MZ\x90\x00"}), ("smb_audit", "smb_audit", {"payload": b"svcctl", "dst_port": 445}), ("credentials", "credentials", {"payload": b"USER bob\r\n", "dst_port": 21})])
def test_detectors_can_be_turned_off(spark, section, detector, row):
    names = [{"protocol": 17, "dns_qname": f"sub{i}.verylongencodedpayloadchunk{i * 1000}.covert-tunnel.org", "dns_qtype": 16} for i in range(10)]
    p = packets(spark, *([row] if row else names))
    assert D.DETECTORS[detector](p, cfg()).count() == 1 and D.DETECTORS[detector](p, cfg(**{section: {"enabled": False}})).count() == 0


def brute_prefix(rows, own):
    """First regular prefix of one flow's (ts_us, payload_len), each prefix judged anew."""
    for k in range(own["min_samples"], len(rows) + 1):
        if (rows[k - 1][0] - rows[0][0]) / 1e6 < own["min_duration_sec"]:
            continue
        full = [t for t, n in rows[:k] if n]
        used = sorted(full if len(full) >= own["min_samples"] else [t for t, _ in rows[:k]])
        gaps = [(b - a) / 1e6 for a, b in zip(used, used[1:], strict=False)]
        mean, median = statistics.fmean(gaps), statistics.median(gaps)
        if mean > 0.001 and median > 0.001 and statistics.pstdev(gaps) / mean <= own["max_cov"] and statistics.median(abs(g - median) for g in gaps) / median <= own["max_mad_ratio"]:
            return k
    return None


def test_beacon_prefixes_equal_judging_each_anew(spark):
    own = {"min_samples": 5, "max_cov": 0.20, "max_mad_ratio": 0.12, "min_duration_sec": 2.0}
    rng, rows, want = random.Random(4), [], {}
    for port in range(40):
        t, flow = 10**15, []
        for i in range(30):
            t += int(10**6 * rng.choice([1, 1, 1, 1.3, 0.9, 1.1] if port % 4 else [1, 5, -2, 0.2]))
            if port % 8 == 3 and i < 12:
                t += rng.randrange(9) * 10**6
            flow.append((t, rng.choice([0, 0, 7]) if port % 3 else 0))
        rows += [{"src_port": port, "ts_us": t, "payload_len": n} for t, n in flow]
        if (k := brute_prefix(flow, own)) is not None:
            want[port] = k
    got = {r["source_port"]: r["packet_count"] for r in D.beacon_prefix(packets(spark, *rows), cfg(beacon=own)).collect()}
    assert got == want and 0 < len(want) < 40
    late = packets(spark, *({"ts_us": 10**15 + x} for x in (0, 1, 2, 10**6, 2 * 10**6, 3 * 10**6, 4 * 10**6)))
    assert D.beacon_online(late, cfg(beacon=own)).count() == D.beacon(late, cfg(beacon=own)).count()


def test_triage_as_a_whole(spark):
    run = triage(packets(spark, *({"src_ip": "10.0.0.9", "dst_ip": f"10.0.0.{i}", "tcp_flags": 2, "src_port": i} for i in range(20, 33))))
    assert run.evidence.count() == 20 and run.timelines.where("entity_ip = '10.0.0.9'").orderBy("nth").first()["nth"] == 1
    text = text_report(run, most=1)
    assert "ALERTS" in text and "more, in the JSON output" in text and len(json.loads(stix_bundle(run))["objects"]) == 3 * run.alerts.count()
    run.close()


@pytest.mark.parametrize("block", [3, 1000])
def test_running_sums_by_blocks(spark, block):
    rows = [{"capture_id": c, "seq": i, "wirelen": i * i, "src_port": i % 2} for c in "ab" for i in range(20)]
    got = {(r["capture_id"], r["seq"]): (r["n"], r["bytes"]) for r in running(packets(spark, *rows), ["src_port"], {"n": F.lit(1), "bytes": F.col("wirelen")}, block=block).collect()}
    assert got == {(c, i): (i // 2 + 1, sum(k * k for k in range(i % 2, i + 1, 2))) for c in "ab" for i in range(20)}
