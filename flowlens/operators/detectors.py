"""The detectors: packets in, alerts out, each a DataFrame query.

Packets have the columns of schemas.PACKETS. An alert has detector, rule_id, capture_id, key (what it is given once for in a
capture), severity, stage, source_ip, target_ip, source_port, target_port, protocol, ts_us, flow_id, seq (the packet that raised
it), phase (0 by a packet, 1 when its flow ends), scope and scope_key (which packets up to seq it refers to, see scopes()),
packet_count and proof, a struct of the numbers that justify it. Every capture is judged by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import config
from flowlens.functions import net
from flowlens.functions.patterns import first_pattern
from flowlens.operators import flows
from flowlens.operators.beacons import Prefix, interval_stats
from flowlens.operators.combinators import crossed, first_match, running
from flowlens.streaming import state
from flowlens.tables import cut

FLOW = ["capture_id", "flow_id"]


def alerts(rows: DataFrame, detector: str, rule: Column | str, key: Column, severity: Column | str, stage: Column | str, protocol: Column | str, proof: list[Column], count: Column | None = None, phase: Column | int = 0, source: Column | None = None, target: Column | None = None, scope: str = "packet", scope_key: str | None = None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        F.lit(detector).alias("detector"), text(rule).alias("rule_id"), "capture_id", key.alias("key"), text(severity).alias("severity"), text(stage).alias("stage"),
        (F.col("src_ip") if source is None else source).alias("source_ip"), (F.col("dst_ip") if target is None else target).alias("target_ip"),
        F.col("src_port").alias("source_port"), F.col("dst_port").alias("target_port"), text(protocol).alias("protocol"), "ts_us", "flow_id", "seq", (F.lit(phase) if isinstance(phase, int) else phase).alias("phase"),
        F.lit(scope).alias("scope"), F.col(scope_key or "seq").cast("string").alias("scope_key"), (F.lit(1) if count is None else count).cast("long").alias("packet_count"), F.struct(*proof).alias("proof"),
    )


def scopes(cfg: dict) -> dict[str, tuple[Column, Column]]:
    """Of packets with flows, which belong to what an alert may refer to, and by what: condition and key of each scope."""
    syn = net.has_bits(F.col("tcp_flags"), 0x02) & ~net.has_bits(F.col("tcp_flags"), 0x10) & (F.col("protocol") == 6)
    echo = (F.col("protocol") == 1) & (F.col("src_port") == 8)
    nets = cfg["lateral"]["internal_subnets"]
    moved = F.col("dst_port").isin(cfg["lateral"]["high_risk_ports"]) & net.is_internal(F.col("src_ip"), nets) & net.is_internal(F.col("dst_ip"), nets)
    qname = F.lower("dns_qname")
    sub, parent = net.split_domain(qname)
    return {
        "packet": (F.lit(True), F.col("seq").cast("string")),
        "flow": (F.lit(True), F.col("flow_id")),
        "sweep": ((syn | echo) & (F.col("src_ip") != F.col("dst_ip")), F.col("src_ip")),
        "scan": (syn, F.col("src_ip")),
        "lateral": (moved, F.col("src_ip")),
        "tunnel": ((F.col("dns_qname") != "") & ~net.is_noise(qname) & (sub != ""), parent),
    }


def subnet_sweep(packets: DataFrame, cfg: dict) -> DataFrame:
    """Sources that try to open connections to many addresses."""
    limit = cfg["sweep"]["sweep_threshold"]
    rows = flows.with_flow(packets).where(scopes(cfg)["sweep"][0])
    raised = crossed(rows, "src_ip", ["dst_ip"], limit, cfg)
    proof = [F.lit("Distinct target addresses").alias("metric"), F.col("src_ip").alias("source_sweeper_host"), F.col("targets").alias("unique_target_ips_count"), F.lit(limit).alias("sweep_threshold"), F.slice("ips", 1, 5).alias("sample_target_ips"), F.slice("ports", 1, 5).alias("sample_target_ports"), F.lit(True).alias("passed_threshold")]
    return alerts(raised, "sweep", "RULE-RECON-SWEEP-01", F.col("src_ip"), "HIGH", "Reconnaissance", "IP/Sweep", proof, F.col("n"), scope="sweep", scope_key="src_ip")


def syn_scan(packets: DataFrame, cfg: dict) -> DataFrame:
    """Sources whose SYN packets reach many ports."""
    limit = cfg["tcpstate"]["syn_scan_threshold"]
    rows = flows.with_flow(packets).where(scopes(cfg)["scan"][0])
    raised = crossed(rows, "src_ip", ["dst_ip", "dst_port"], limit, cfg)
    proof = [F.lit("Distinct target ports").alias("metric"), F.col("src_ip").alias("source_host"), F.col("targets").alias("unique_target_ports_count"), F.lit(limit).alias("scan_threshold"), F.lit("SYN without ACK").alias("state_pattern"), F.lit(True).alias("passed_gate")]
    return alerts(raised, "tcpstate", "RULE-TCP-SCAN-01", F.col("src_ip"), "HIGH", "Reconnaissance", "TCP", proof, F.col("n"), scope="scan", scope_key="src_ip")


def flag_anomalies(packets: DataFrame, cfg: dict) -> DataFrame:
    """TCP packets with flags that no handshake has."""
    rows = flows.with_flow(packets).where("protocol = 6").withColumn("anomaly", net.flag_anomaly(F.col("tcp_flags"))).where("anomaly is not null")
    rows = rows.where(F.lit(bool(cfg["tcpstate"]["flag_anomalies_enabled"])))
    rows = watch.rows(rows, [], None) if (watch := state.watching(cfg)) else rows
    proof = [F.lit("TCP flags").alias("metric"), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("tcp_flags")), 3, "0")).alias("raw_flags_hex"), net.flag_names(F.col("tcp_flags")).alias("parsed_flag_names"), F.col("anomaly").alias("anomaly_classification")]
    return alerts(rows, "tcpstate", "RULE-TCP-FLAGS-01", F.concat_ws(":", "capture_id", F.col("file_offset").cast("string")), "MEDIUM", "Reconnaissance", "TCP", proof)


def lateral(packets: DataFrame, cfg: dict) -> DataFrame:
    """Internal sources that reach many internal hosts on management ports."""
    own = cfg["lateral"]
    rows = flows.with_flow(packets).where(scopes(cfg)["lateral"][0])
    raised = crossed(rows, "src_ip", ["dst_ip", "dst_port"], own["fanout_threshold"], cfg)
    proof = [
        F.lit("Distinct internal targets").alias("metric"), F.col("src_ip").alias("source_internal_host"), F.col("targets").alias("unique_internal_targets_count"), F.lit(own["fanout_threshold"]).alias("fanout_threshold"),
        F.col("ports").alias("ports_contacted"), F.array(*map(F.lit, own["high_risk_ports"])).alias("high_risk_ports_monitored"), F.slice("ips", 1, 5).alias("sample_target_ips"), F.lit(True).alias("passed_threshold"),
    ]
    return alerts(raised, "lateral", "RULE-LATERAL-MOVE-01", F.col("src_ip"), "HIGH", "Lateral Movement", "TCP/Pivoting", proof, F.col("n"), scope="lateral", scope_key="src_ip")


def exfil_dns(packets: DataFrame, cfg: dict) -> DataFrame:
    """The first DNS query of a flow that is long or of type TXT."""
    rows = flows.with_flow(packets).where((F.col("dns_qname") != "") & ((F.col("dns_qtype") == 16) | (F.length("dns_qname") > 64)))
    proof = [F.lit("Length or type of a DNS query").alias("metric"), F.col("dns_qname").alias("dns_qname"), F.length("dns_qname").alias("payload_char_len"), F.col("dns_qtype").alias("qtype"), F.lit(64).alias("threshold_len")]
    return alerts(first_match(rows, ["flow_id"], cfg=cfg), "exfil", "RULE-EXFIL-DNS-01", F.col("dns_qname"), "HIGH", "Exfiltration", "UDP/DNS", proof)


def _ended(flow_rows: DataFrame) -> DataFrame:
    return flow_rows.withColumnsRenamed({"endpoint_a_ip": "src_ip", "endpoint_b_ip": "dst_ip", "endpoint_a_port": "src_port", "endpoint_b_port": "dst_port", "last_ts_us": "ts_us", "last_seq": "seq"})


def exfil_volume(packets: DataFrame, cfg: dict) -> DataFrame:
    """Flows of many bytes that raised no DNS alert."""
    least = cfg["exfil"]["min_exfil_bytes"]
    if state.watching(cfg):
        closed = state.flow_events(flows.with_flow(packets), cfg, (F.col("event") == "closed") & (F.col("byte_count") >= least) & ~F.col("dns"))
        big = closed.withColumn("duration_sec", F.when(F.col("packet_count") > 1, (F.col("ts_us") - F.col("start_ts_us")) / F.lit(1e6)).otherwise(0.0))
    else:
        big = _large(packets, cfg, least)
    proof = [F.lit("Bytes of a flow").alias("metric"), F.col("byte_count").alias("total_bytes_transferred"), F.round(F.col("byte_count") / 1048576, 2).alias("volume_mb"), F.lit(least).alias("volume_threshold_bytes"), F.col("duration_sec")]
    return alerts(big, "exfil", "RULE-EXFIL-VOL-01", F.col("flow_id"), "HIGH", "Exfiltration", F.col("protocol").cast("string"), proof, F.col("packet_count"), 1, scope="flow", scope_key="flow_id")


def _large(packets: DataFrame, cfg: dict, least: int) -> DataFrame:
    big = flows.aggregate(packets).where(F.col("byte_count") >= least).join(exfil_dns(packets, cfg).select(*FLOW), FLOW, "left_anti")
    return _ended(big)


def _names(packets: DataFrame) -> DataFrame:
    """DNS packets other than noise, with qname in lower case, sub and parent."""
    rows = flows.with_flow(packets).where(F.col("dns_qname") != "").withColumn("qname", F.lower("dns_qname")).where(~net.is_noise(F.col("qname")))
    sub, parent = net.split_domain(F.col("qname"))
    return rows.withColumn("sub", sub).withColumn("parent", parent)


def dga(packets: DataFrame, cfg: dict) -> DataFrame:
    """DNS names that look generated: high entropy or long runs of consonants."""
    own = cfg["entropy"]
    rows = first_match(_names(packets).where(F.length("sub") >= own["min_subdomain_len"]), ["qname"], cfg=cfg)
    rows = rows.withColumn("entropy", net.entropy(F.col("sub"))).withColumn("run", net.consonant_run(F.col("sub")))
    rows = rows.where((F.col("entropy") >= own["entropy_threshold"]) | (F.col("run") >= own["consonant_cluster_len"]))
    proof = [
        F.lit("Entropy and consonants of a DNS name").alias("metric"), F.col("qname").alias("dns_qname"), F.col("sub").alias("subdomain_analyzed"), F.col("parent").alias("parent_domain"),
        F.length("sub").alias("subdomain_length"), F.lit(own["min_subdomain_len"]).alias("min_subdomain_len_threshold"), F.col("entropy").alias("shannon_entropy_calculated"), F.lit(own["entropy_threshold"]).alias("entropy_threshold"),
        F.col("run").alias("consonant_cluster_run"), F.lit(own["consonant_cluster_len"]).alias("consonant_cluster_threshold"), net.char_shares(F.col("sub")).alias("char_probabilities"),
        F.lit("H = -sum p log2 p").alias("formula"), F.lit(True).alias("ad_noise_filter_passed"),
    ]
    return alerts(rows, "entropy", "RULE-DNS-DGA-01", F.col("qname"), "HIGH", "Command & Control", "UDP/DNS", proof)


def _enabled(cfg: dict, section: str) -> Column:
    return F.lit(bool(cfg[section].get("enabled", True)))


def _tunnels(rows: DataFrame, own: dict) -> DataFrame:
    """rows (parent, sub, is_odd) at the first that passes, with n, chars, odd, samples, and first, the ends of the first query."""
    sums = {"n": F.lit(1), "chars": F.length("sub"), "odd": F.col("is_odd").cast("long")}
    hit = running(rows.select("capture_id", "parent", "seq", "sub", "is_odd"), ["parent"], sums)
    hit = hit.where((F.col("n") >= own["min_queries"]) & (F.col("chars") / F.col("n") >= own["min_avg_subdomain_len"]))
    found = hit.groupBy("capture_id", "parent").agg(F.min_by(F.struct("seq", "n", "chars", "odd"), "seq").alias("c")).select("capture_id", "parent", "c.*")
    begun = rows.groupBy("capture_id", "parent").agg(F.min_by(F.struct("src_ip", "dst_ip"), "seq").alias("first"))
    samples = rows.join(found.select("capture_id", "parent", F.col("seq").alias("at")), ["capture_id", "parent"]).where(F.col("seq") <= F.col("at"))
    samples = samples.groupBy("capture_id", "parent", "sub").agg(F.min("seq").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("capture_id", "parent").orderBy("seq"))
    samples = samples.withColumn("nth", nth).where("nth <= 5").groupBy("capture_id", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sub"))), lambda x: x["sub"]).alias("samples"))
    return rows.join(found, ["capture_id", "parent", "seq"]).join(begun, ["capture_id", "parent"]).join(samples, ["capture_id", "parent"])


def dns_tunnel(packets: DataFrame, cfg: dict) -> DataFrame:
    """Parent domains with many queries for long subdomains."""
    own = cfg["dns_tunnel"]
    rows = _names(packets).where(F.col("sub") != "").where(_enabled(cfg, "dns_tunnel"))
    odd = F.coalesce(F.col("dns_qtype").isin(5, 10, 15, 16), F.lit(False)) | (F.length("sub") > 30)
    rows = rows.withColumn("is_odd", odd)
    raised = state.tunnels(rows, own["min_queries"], own["min_avg_subdomain_len"], watch) if (watch := state.watching(cfg)) else _tunnels(rows, own)
    proof = [
        F.lit("Queries and length of subdomains").alias("metric"), F.col("parent").alias("target_parent_domain"), F.col("n").alias("total_queries_received"), F.lit(own["min_queries"]).alias("min_queries_threshold"),
        F.round(F.col("chars") / F.col("n"), 2).alias("avg_subdomain_len_calculated"), F.lit(own["min_avg_subdomain_len"]).alias("min_avg_subdomain_len_threshold"), F.col("odd").alias("txt_cname_null_queries"), F.col("samples").alias("sample_subdomains"),
    ]
    return alerts(raised, "dns_tunnel", "RULE-DNS-TUNNEL-01", F.col("parent"), "HIGH", "Command & Control", "UDP/DNS", proof, F.col("n"), source=F.col("first.src_ip"), target=F.col("first.dst_ip"), scope="tunnel", scope_key="parent")


def http_requests(packets: DataFrame) -> DataFrame:
    """Packets on web ports that hold a request: method, uri and agent; a DNS name stands in for a missing payload."""
    rows = flows.with_flow(packets).where(F.col("dst_port").isin(config.HTTP_PORTS) | F.col("src_port").isin(config.HTTP_PORTS))
    text = F.coalesce(net.ascii_text(F.col("payload")), F.lit(""))
    named = F.when((text == "") & (F.col("dns_qname") != ""), F.concat(F.lit("GET /"), "dns_qname", F.lit(" HTTP/1.1\r\n"))).otherwise(text)
    method, uri, agent = net.http_request(named)
    return rows.withColumns({"method": method, "uri": uri, "agent": agent}).where("method is not null")


def http_audit(packets: DataFrame, cfg: dict) -> DataFrame:
    """One alert for a flow: web shell, else scripted agent, else risky method, at its first such packet."""
    rows = http_requests(packets)
    shell = net.first_of([(F.col("uri").rlike("(?i)" + p), p) for p in config.WEBSHELLS])
    script = net.first_of([(F.lower("agent").contains(a), a) for a in config.SCRIPT_AGENTS])
    rows = rows.withColumns({"shell": shell, "script": F.when(F.col("agent") != "", script)})
    rule = F.when(F.col("shell").isNotNull(), "RULE-HTTP-WEBSHELL-01").when(F.col("script").isNotNull(), "RULE-HTTP-USERAGENT-01").when(F.col("method").isin(config.RISKY_METHODS), "RULE-HTTP-METHOD-01")
    found = first_match(rows.withColumn("rule", rule).where("rule is not null"), ["flow_id"], cfg=cfg)
    severity = F.when(F.col("shell").isNotNull(), "HIGH").otherwise("MEDIUM")
    stage = F.when(F.col("shell").isNotNull(), "Initial Access").when(F.col("script").isNotNull(), "Reconnaissance").otherwise("Defense Evasion")
    proof = [F.lit("HTTP request").alias("metric"), F.col("method").alias("http_method"), F.col("uri").alias("request_uri"), F.col("shell").alias("signature_matched"), F.when(F.col("shell").isNull(), F.col("script")).alias("matched_agent_keyword"), F.coalesce("agent", F.lit("<none>")).alias("user_agent")]
    return alerts(found, "http_audit", F.col("rule"), F.col("flow_id"), severity, stage, "HTTP", proof)


def tls_hellos(packets: DataFrame, cfg: dict | None = None) -> DataFrame:
    """The first Client Hello of each flow with its fingerprints."""
    first = first_match(flows.with_flow(packets).where("tls_info is not null"), ["flow_id"], cfg=cfg)
    return first.withColumn("ja3", net.ja3_text(F.col("tls_info"))).withColumn("ja3_hash", F.md5(F.col("ja3").cast("binary"))).withColumn("ja4", net.ja4(F.col("tls_info")))


def ja3(packets: DataFrame, cfg: dict) -> DataFrame:
    """Known fingerprints of malware."""
    intel = packets.sparkSession.createDataFrame(cfg.get("ja3_intel") or config.JA3_INTEL, "ja3_hash string, malware string")
    found = tls_hellos(packets, cfg).join(F.broadcast(intel), "ja3_hash")  # a list of the rules, some rows
    proof = [F.lit("TLS fingerprint").alias("metric"), F.col("ja3").alias("ja3_string"), F.col("ja3_hash").alias("ja3_hash_md5"), F.col("ja4").alias("ja4_fingerprint"), F.col("malware").alias("threat_intel_match"), F.col("tls_info.sni").alias("sni_hostname")]
    return alerts(found, "ja3_fingerprint", "RULE-TLS-JA3-01", F.col("ja3_hash"), "CRITICAL", "Command & Control", "TCP/TLS", proof)


def file_magic(packets: DataFrame, cfg: dict) -> DataFrame:
    """File signatures in the first bytes of clear payloads, once for a flow."""
    rows = flows.with_flow(packets).where(~F.col("endpoint_a_port").isin(config.ENCRYPTED_PORTS) & ~F.col("endpoint_b_port").isin(config.ENCRYPTED_PORTS) & (F.octet_length("payload") >= 4) & _enabled(cfg, "file_carver"))
    if listed := cfg["file_carver"].get("signatures"):  # a list of the user's own: bytes, name, severity, stage
        told = first_pattern(F.substring("payload", 1, 512), [m for m, *_ in listed])
        facts = F.array(*(F.struct(*(F.lit(x) for x in (m.hex(), *rest))) for m, *rest in listed))
        rows = rows.withColumn("told", told).where("told is not null").withColumn("fact", F.get(facts, F.col("told.place")))
        return _signed(rows.select("*", *(F.col(f"fact.col{i}").alias(c) for i, c in enumerate(("magic", "file", "sev", "stg"), 1)), F.col("told.at").alias("at")).drop("told", "fact"), cfg)
    at = {m: F.expr(f"position(X'{m.hex()}', substring(payload, 1, 512))") for m, *_ in config.MAGIC}
    pick = lambda value: F.coalesce(*(F.when(at[m[0]] > 0, value(m)) for m in config.MAGIC))
    rows = rows.withColumns({"magic": pick(lambda m: F.lit(m[0].hex())), "file": pick(lambda m: F.lit(m[1])), "sev": pick(lambda m: F.lit(m[2])), "stg": pick(lambda m: F.lit(m[3])), "at": pick(lambda m: at[m[0]] - 1)})
    return _signed(rows.where("magic is not null"), cfg)


def _signed(rows: DataFrame, cfg: dict) -> DataFrame:
    found = first_match(rows, ["flow_id"], cfg=cfg)
    proof = [F.lit("File signature").alias("metric"), F.col("flow_id").alias("flow_id"), F.lit(True).alias("unencrypted_channel"), F.col("file").alias("detected_file_type"), F.col("magic").alias("magic_bytes_hex"), F.decode(F.unhex("magic"), "ISO-8859-1").alias("magic_bytes_ascii"), F.col("at").alias("payload_offset")]
    return alerts(found, "file_carver", "RULE-FILE-MAGIC-01", F.concat("flow_id", F.lit("+"), "magic"), F.col("sev"), F.col("stg"), F.col("protocol").cast("string"), proof)


def _unseen(rows: DataFrame, most: int) -> DataFrame:
    """rows (keys, of `most` different ones) at each first of a pair of hosts' keys, with its name.

    Only packets with new combinations of keys matter: after as many equal packets as they have keys all are reported. Those
    few of each pair of hosts are folded in order."""
    again = Window.partitionBy("capture_id", "endpoint_a_ip", "endpoint_b_ip", "keys").orderBy("seq")
    rows = rows.withColumn("turn", F.row_number().over(again)).where(F.col("turn") <= most).where(F.col("turn") <= F.size("keys"))
    state = "struct<seen:array<string>,out:array<struct<seq:bigint,name:string>>>"
    start = F.from_json(F.lit('{"seen":[],"out":[]}'), state)

    def step(acc: Column, row: Column) -> Column:
        new = F.get(F.array_except(row["keys"], acc["seen"]), F.lit(0))
        told = F.when(new.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(row["seq"].cast("long").alias("seq"), new.alias("name")))))
        return F.struct(F.when(new.isNull(), acc["seen"]).otherwise(F.concat(acc["seen"], F.array(new))).alias("seen"), told.alias("out"))

    pair = ["capture_id", "endpoint_a_ip", "endpoint_b_ip"]
    folded = rows.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("seq", "keys"))).alias("rows"))
    told = folded.select(*pair, F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select(*pair, F.col("o.seq").alias("seq"), F.col("o.name").alias("name"))
    return rows.drop("keys", "turn").join(told, [*pair, "seq"])


def smb_audit(packets: DataFrame, cfg: dict) -> DataFrame:
    """Named pipes and administrative shares: a packet reports its first key that its hosts have not reported before."""
    rows = flows.with_flow(packets).where((F.col("endpoint_a_port").isin(config.SMB_PORTS) | F.col("endpoint_b_port").isin(config.SMB_PORTS)) & (F.octet_length("payload") > 0) & _enabled(cfg, "smb_audit"))
    text = F.lower(F.decode("payload", "ISO-8859-1"))
    three = text.contains("\\" * 3)
    tests = [(name, text.contains(name)) for name, *_ in config.PIPES] + [(name, text.contains("\\\\" + name) | (three & text.contains(name))) for name, *_ in config.SHARES]
    keys = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())
    rows = rows.withColumn("keys", keys).where(F.size("keys") > 0)
    pair = ["endpoint_a_ip", "endpoint_b_ip"]
    found = state.unseen(rows, pair, watch) if (watch := state.watching(cfg)) else _unseen(rows, len(tests))
    pick = lambda i: F.coalesce(*(F.when(F.col("name") == r[0], F.lit(r[i])) for r in [*config.PIPES, *config.SHARES]))
    rule = F.when(F.col("name").isin([r[0] for r in config.PIPES]), "RULE-SMB-PIPE-01").otherwise("RULE-SMB-SHARE-01")
    is_pipe = F.col("name").isin([r[0] for r in config.PIPES])
    proof = [F.lit("SMB resource").alias("metric"), F.col("name").alias("resource"), F.when(is_pipe, F.col("name")).alias("named_pipe"), F.when(~is_pipe, F.col("name")).alias("share_name"), F.col("dst_port").alias("smb_port"), F.col("flow_id").alias("flow_id")]
    return alerts(found, "smb_audit", rule, F.concat("endpoint_a_ip", F.lit("->"), "endpoint_b_ip", F.lit(":"), "name"), pick(1), pick(2), "TCP/SMB", proof)


def credentials(packets: DataFrame, cfg: dict) -> DataFrame:
    """User names sent in clear text by HTTP Basic, FTP, POP3, SMTP and Telnet, once for a flow; the secret itself is not kept.

    The reference has no source of this detector, so this is a design of our own after what it is said to do."""
    rows = flows.with_flow(packets).where((F.octet_length("payload") > 0) & _enabled(cfg, "credentials")).withColumn("text", net.ascii_text(F.col("payload")))
    on = lambda *ports: F.col("dst_port").isin(*ports) | F.col("src_port").isin(*ports)
    basic = F.decode(F.try_to_binary(F.regexp_extract("text", r"(?im)^authorization:\s*basic\s+([A-Za-z0-9+/=]+)", 1), F.lit("base64")), "ISO-8859-1")
    plain = F.decode(F.try_to_binary(F.regexp_extract("text", r"(?im)^AUTH PLAIN\s+([A-Za-z0-9+/=]+)", 1), F.lit("base64")), "ISO-8859-1")
    user = (
        F.when(on(*config.HTTP_PORTS), F.substring_index(basic, ":", 1))
        .when(on(21, 110), F.regexp_extract("text", r"(?im)^USER\s+(\S+)", 1))
        .when(on(25, 587), F.get(F.split(plain, "\u0000"), F.lit(1)))
        .when(on(23), F.regexp_extract("text", r"(?i)login:\s*(\S+)", 1))
    )
    service = F.when(on(*config.HTTP_PORTS), "HTTP").when(on(21), "FTP").when(on(110), "POP3").when(on(25, 587), "SMTP").otherwise("TELNET")
    found = first_match(rows.withColumn("user", user).withColumn("service", service).where("user <> ''"), ["flow_id"], cfg=cfg)
    proof = [F.lit("Clear text credential").alias("metric"), F.col("user").alias("extracted_user"), F.col("user").alias("username"), F.col("service").alias("protocol")]
    return alerts(found, "credentials", "RULE-CRED-CLEARTEXT-01", F.col("flow_id"), "HIGH", "Credential Access", F.col("service"), proof)


def _beacon_proof(own: dict) -> list[Column]:
    r = lambda c: F.round(F.col(c), 4)
    return [
        F.lit("Regularity of gaps").alias("metric"), (F.col("n") + 1).alias("sample_count_N"), F.lit(own["min_samples"]).alias("sample_gate_min_N"), r("mean").alias("mean_iat_sec"), r("stddev").alias("stddev_iat_sec"),
        F.round(F.col("stddev") / F.col("mean"), 4).alias("cov_calculated"), F.lit(own["max_cov"]).alias("cov_threshold"), r("median").alias("median_iat_sec"), r("mad").alias("mad_sec"),
        F.round(F.col("mad") / F.col("median"), 4).alias("mad_ratio_calculated"), F.lit(own["max_mad_ratio"]).alias("mad_ratio_threshold"), F.lit("stddev / mean").alias("formula_cov"), F.lit("mad / median").alias("formula_mad"),
        F.lit(True).alias("passed_gate"),
    ]


def beacon(packets: DataFrame, cfg: dict) -> DataFrame:
    """Flows with regular gaps, judged when they end."""
    own = cfg["beacon"]
    stats = interval_stats(packets, own["min_samples"], own).where((F.col("median") > 0.001) & (F.col("mad") / F.col("median") <= own["max_mad_ratio"]))
    rows = _ended(flows.aggregate(packets).join(stats, FLOW))
    return alerts(rows, "beacon", "RULE-C2-BEACON-01", F.col("flow_id"), "HIGH", "Command & Control", F.col("protocol").cast("string"), _beacon_proof(own), F.col("packet_count"), 1, scope="flow", scope_key="flow_id")


def _regular_so_far(rows: DataFrame, own: dict) -> DataFrame:
    """Flows, and the last packet (last) at which their gaps may be regular: by running sums of gaps and their squares, with some
    room for rounding. Flows whose times don't rise with seq can be regular anywhere."""
    by = Window.partitionBy(*FLOW).orderBy("seq")
    gap = F.col("ts_us") - F.lag("ts_us").over(by)
    full_before = F.last(F.when(F.col("payload_len") > 0, F.col("ts_us")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    full = F.col("payload_len") > 0
    second = 1e6
    steps = rows.withColumns({"gap": gap, "full_gap": F.when(full, F.col("ts_us") - full_before), "is_full": full.cast("long")})
    steps = steps.withColumns({"g": F.coalesce(F.col("gap") / second, F.lit(0.0)), "fg": F.coalesce(F.col("full_gap") / second, F.lit(0.0)), "back": F.coalesce(F.col("gap") < 0, F.lit(False)).cast("long")})
    to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: F.sum(c).over(to)
    sums = steps.select(*FLOW, "seq", F.count("*").over(to).alias("k"), run("is_full").alias("fk"), run("g").alias("s"), run(F.col("g") * F.col("g")).alias("q"), run("fg").alias("fs"), run(F.col("fg") * F.col("fg")).alias("fq"), run("back").alias("back"))
    by_full = F.col("fk") >= own["min_samples"]
    n, s, q = F.when(by_full, F.col("fk")).otherwise(F.col("k")) - 1, F.when(by_full, F.col("fs")).otherwise(F.col("s")), F.when(by_full, F.col("fq")).otherwise(F.col("q"))
    mean = s / F.greatest(n, F.lit(1))
    square = F.greatest(q / F.greatest(n, F.lit(1)) - mean * mean, F.lit(0.0))
    enough = (F.col("k") >= own["min_samples"]) & ((F.col("back") > 0) | ((mean > 0.0009) & (square <= (own["max_cov"] * mean) * (own["max_cov"] * mean) * 1.001 + 1e-9)))
    return sums.where(enough).groupBy(*FLOW).agg(F.max("seq").alias("last"))


def beacon_prefix(packets: DataFrame, cfg: dict) -> DataFrame:
    """Flows with regular gaps, judged after each packet once enough and long enough: the first prefix that passes.

    Running sums in Spark leave the flows whose mean and deviation pass somewhere. These are folded packet by packet, each
    insertion and each judgement by bisection, as far as the first pass; a flow's fold keeps its times and gaps, 16 bytes a packet."""
    own = cfg["beacon"]
    rows = flows.with_flow(packets).select(*FLOW, "seq", "ts_us", "payload_len")

    def first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prefix = pdf.sort_values("seq"), Prefix(own)
        for k, (t, f) in enumerate(zip(pdf["ts_us"].tolist(), (pdf["payload_len"] > 0).tolist(), strict=True), 1):
            if (stats := prefix.add(t, f)) is not None:
                return pd.DataFrame([(pdf["capture_id"].iloc[0], pdf["flow_id"].iloc[0], int(pdf["seq"].iloc[k - 1]), k, *stats)], columns=names)
        return pd.DataFrame([], columns=names)

    names = ["capture_id", "flow_id", "seq", "packet_count", "n", "mean", "stddev", "median", "mad"]
    form = "capture_id string, flow_id string, seq long, packet_count long, n long, mean double, stddev double, median double, mad double"
    found = rows.join(_regular_so_far(rows, own), FLOW).where(F.col("seq") <= F.col("last")).groupBy(*FLOW).applyInPandas(first_pass, form)
    at = flows.with_flow(packets).drop("src_ip", "dst_ip", "src_port", "dst_port").withColumnsRenamed({"endpoint_a_ip": "src_ip", "endpoint_b_ip": "dst_ip", "endpoint_a_port": "src_port", "endpoint_b_port": "dst_port"})
    return alerts(at.join(found, [*FLOW, "seq"]), "beacon", "RULE-C2-BEACON-01", F.col("flow_id"), "HIGH", "Command & Control", F.col("protocol").cast("string"), _beacon_proof(own), F.col("packet_count"), scope="flow", scope_key="flow_id")


def _busy(packets: DataFrame, least: int) -> DataFrame:
    """What regularity asks of the packets of flows that have `least` packets or more; no other flow is ever regular."""
    rows = flows.with_flow(packets).select(*FLOW, *(f"endpoint_{e}_{x}" for e in "ab" for x in ("ip", "port")), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "seq", "ts_us", "wirelen", "payload_len")
    return rows.join(rows.groupBy(*FLOW).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*FLOW), FLOW, "left_semi")


def beacon_online(packets: DataFrame, cfg: dict) -> DataFrame:
    """Once for a flow: at its first prefix with regular gaps, else when it ends if its gaps are regular then."""
    if state.watching(cfg):
        told = state.flow_events(flows.with_flow(packets), cfg, F.col("n").isNotNull())
        return alerts(told, "beacon", "RULE-C2-BEACON-01", F.col("flow_id"), "HIGH", "Command & Control", F.col("protocol").cast("string"), _beacon_proof(cfg["beacon"]), F.col("packet_count"), F.when(F.col("event") == "closed", 1).otherwise(0), scope="flow", scope_key="flow_id")
    busy = cut(_busy(packets, cfg["beacon"]["min_samples"]))
    early = cut(beacon_prefix(busy, cfg))
    return early.unionByName(beacon(busy, cfg).join(early.select(*FLOW), FLOW, "left_anti"))


#: In the order in which a packet is shown to them; a detector is any function of packets and configuration that returns alerts.
DETECTORS = {
    "beacon": beacon_online, "credentials": credentials, "lateral": lateral, "exfil_dns": exfil_dns, "exfil_volume": exfil_volume, "dga": dga, "sweep": subnet_sweep,
    "http_audit": http_audit, "ja3": ja3, "flag_anomalies": flag_anomalies, "syn_scan": syn_scan, "file_magic": file_magic, "smb_audit": smb_audit, "dns_tunnel": dns_tunnel,
}
