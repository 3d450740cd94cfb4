"""Alerts of all detectors: union, ids, dedup, correlation by host, telemetry and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import config
from flowlens.functions import net
from flowlens.operators import flows
from flowlens.operators.detectors import DETECTORS, scopes

PREFIXES = {
    "RULE-C2-BEACON-01": "ALT-BEACON", "RULE-CRED-CLEARTEXT-01": "ALT-CRED", "RULE-LATERAL-MOVE-01": "ALT-LATERAL", "RULE-EXFIL-DNS-01": "ALT-DNSEXFIL",
    "RULE-EXFIL-VOL-01": "ALT-EXFIL", "RULE-DNS-DGA-01": "ALT-DGA", "RULE-RECON-SWEEP-01": "ALT-SWEEP", "RULE-HTTP-WEBSHELL-01": "ALT-WEBSHELL",
    "RULE-HTTP-USERAGENT-01": "ALT-SCRIPTUA", "RULE-HTTP-METHOD-01": "ALT-HTTPMETHOD", "RULE-TLS-JA3-01": "ALT-JA3", "RULE-TCP-FLAGS-01": "ALT-FLAGANOM",
    "RULE-TCP-SCAN-01": "ALT-TCPSCAN", "RULE-FILE-MAGIC-01": "ALT-CARVE", "RULE-SMB-PIPE-01": "ALT-SMB-PIPE", "RULE-SMB-SHARE-01": "ALT-SMB-SHARE", "RULE-DNS-TUNNEL-01": "ALT-TUNNEL",
}
COLUMNS = ["alert_id", "rule_id", "title", "description", "severity", "stage", "source_ip", "target_ip", "source_port", "target_port", "protocol", "ts_us", "flow_id", "packet_count", "proof", "detector", "capture_id", "key", "seq", "phase", "module", "scope", "scope_key"]


#: Title of each rule, and the field of its proof that completes it.
TITLES = {
    "RULE-C2-BEACON-01": ("Beaconing at regular intervals", ""), "RULE-CRED-CLEARTEXT-01": ("Credential sent in clear text", ""), "RULE-LATERAL-MOVE-01": ("Lateral movement between internal hosts", ""),
    "RULE-EXFIL-DNS-01": ("Data in DNS queries", ""), "RULE-EXFIL-VOL-01": ("Large transfer", ""), "RULE-DNS-DGA-01": ("Generated DNS name", ""), "RULE-RECON-SWEEP-01": ("Sweep of addresses", ""),
    "RULE-HTTP-WEBSHELL-01": ("Web shell request", ""), "RULE-HTTP-USERAGENT-01": ("Scripted agent: ", "user_agent"), "RULE-HTTP-METHOD-01": ("Risky HTTP method: ", "http_method"),
    "RULE-TLS-JA3-01": ("TLS fingerprint of malware: ", "threat_intel_match"), "RULE-TCP-FLAGS-01": ("TCP flags: ", "anomaly_classification"), "RULE-TCP-SCAN-01": ("SYN scan of ports", ""),
    "RULE-FILE-MAGIC-01": ("File Signature: ", "detected_file_type"), "RULE-SMB-PIPE-01": ("SMB pipe ", "resource"), "RULE-SMB-SHARE-01": ("SMB share ", "resource"), "RULE-DNS-TUNNEL-01": ("DNS tunnel", ""),
}


def _of(rule: Column, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[rule]


def alert_id(rule: Column, capture: Column, key: Column) -> Column:
    """The same for the same rule, capture and key in every run."""
    return F.concat(F.coalesce(_of(rule, PREFIXES), F.lit("ALT")), F.lit("-"), F.substring(F.md5(F.concat(capture, F.lit("|"), key).cast("binary")), 1, 12))


def title(rule: Column, fields: list[str]) -> Column:
    """Of alerts whose proof, a struct, has these fields."""
    told = [F.when(rule == r, F.col(f"proof.{f}").cast("string")) for r, (_, f) in TITLES.items() if f in fields]
    return F.concat(F.coalesce(_of(rule, {r: t for r, (t, _) in TITLES.items()}), rule), F.coalesce(*told, F.lit("")))


def description(fields: list[str]) -> Column:
    """What was measured, between which ends."""
    metric = F.col("proof.metric") if "metric" in fields else F.lit(None).cast("string")
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(metric, F.lit(": "), of("source_ip"), F.lit(":"), of("source_port"), F.lit(" to "), of("target_ip"), F.lit(":"), of("target_port"))


def union(packets: DataFrame, cfg: dict, detectors: dict | None = None) -> DataFrame:
    """Alerts of all detectors in one form; proof is JSON."""
    parts = []
    for place, (_, detect) in enumerate((detectors or DETECTORS).items()):
        rows = detect(packets, cfg)
        fields = rows.select("proof.*").columns
        parts.append(rows.withColumns({"title": title(F.col("rule_id"), fields), "description": description(fields)}).withColumns({"proof": F.to_json("proof"), "module": F.lit(place)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("alert_id", alert_id(F.col("rule_id"), F.col("capture_id"), F.col("key"))).select(COLUMNS)


def ordered() -> Column:
    """When an alert comes: capture by capture, by packets first, then at the ends of flows; of one packet in the order of detectors."""
    return F.struct("capture_id", "phase", "seq", "module")


def dedup(alerts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One alert for each id: the last one, at the place of the first; with columns, only these and those of its place, so that
    nothing else is made and shuffled."""
    rest = [c for c in alerts.columns if c != "alert_id" and (columns is None or c in (*columns, "capture_id", "phase", "seq", "module"))]
    out = alerts.groupBy("alert_id").agg(F.max_by(F.struct(*rest), ordered()).alias("_last"), F.min(ordered()).alias("_place"))
    return out.select("alert_id", "_last.*", F.col("_place").alias("place"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    """A row for each severity, with zeros."""
    every = F.explode(F.array(*map(F.lit, config.SEVERITIES))).alias("severity")
    counts = alerts.groupBy("severity").agg(F.count("*").alias("alerts"))
    return alerts.sparkSession.range(1).select(every).join(counts, "severity", "left").select("severity", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def search(alerts: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    """Alerts of a severity whose id, title, description or addresses contain the text."""
    out = alerts if severity is None else alerts.where(F.col("severity") == severity)
    low = text.lower()
    return out.where(F.lower("alert_id").contains(low) | F.lower("title").contains(low) | F.lower("description").contains(low) | F.col("source_ip").contains(text) | F.col("target_ip").contains(text)) if text else out


def stage_place(stage: Column) -> Column:
    return F.coalesce(_of(stage, {s: i for i, s in enumerate(config.STAGES, 1)}), F.lit(99))


def entities(alerts: DataFrame) -> DataFrame:
    """Each alert for its source and, if there is one and it is another, its target."""
    both = F.array_distinct(F.filter(F.array("source_ip", "target_ip"), lambda x: x.isNotNull() & (x != "")))
    return alerts.withColumn("entity_ip", F.explode(both))


def timelines(alerts: DataFrame) -> DataFrame:
    """Stages of each host by first appearance, their plausibility score and alignment. An alert counts by its time, then its place."""
    rows = entities(alerts).withColumn("when", F.struct("ts_us", "capture_id", "phase", "seq", "module"))
    stages = rows.groupBy("entity_ip", "stage").agg(F.min("when").alias("when"), F.count("*").alias("n"))
    stages = stages.withColumn("ord", stage_place(F.col("stage")))
    out = stages.groupBy("entity_ip").agg(F.sum("n").alias("total_alerts"), F.array_sort(F.collect_list(F.struct("when", "stage", "ord"))).alias("s"))  # a stage each
    ords = F.transform("s", lambda x: x["ord"])
    steps = F.zip_with(F.slice(ords, 1, F.greatest(F.size(ords) - 1, F.lit(0))), F.slice(ords, 2, F.size(ords)), lambda a, b: a <= b)
    out = out.withColumn("stages_covered", F.transform("s", lambda x: x["stage"])).withColumn("rising", F.forall(steps, lambda x: x))
    score = F.least(F.size("s") / 5, F.lit(1.0)) * 60 + F.when(F.col("rising") & (F.size("s") > 1), 40.0).otherwise(15.0)
    return out.select("entity_ip", "total_alerts", "stages_covered", F.round(score, 1).alias("plausibility_score"), F.when(F.col("rising"), "High").otherwise("Moderate").alias("chronological_alignment"))


def timeline_alerts(alerts: DataFrame) -> DataFrame:
    """The alerts of each host in order of time: entity_ip, nth (from 1), alert_id, ts_us, stage and severity. Alerts of one host are
    few as against packets; those of a host with very many are numbered in one task."""
    by = Window.partitionBy("entity_ip").orderBy("ts_us", "capture_id", "phase", "seq", "module")
    return entities(alerts).select("entity_ip", F.row_number().over(by).alias("nth"), "alert_id", "ts_us", "stage", "severity")


def bridge(alerts: DataFrame, packets: DataFrame, cfg: dict | None = None) -> DataFrame:
    """alert_id, capture_id, seq and other columns of each packet that an alert refers to: the packets of its scope up to it.

    Scope by scope the packets in it meet its alerts by key, so packets are dealt by flow and by number, and where a scope has few
    alerts (sources, domains) not at all; a frequent key's packets are dealt by the join."""
    rows, out = flows.with_flow(packets), None
    slim = ["capture_id", F.col("seq").alias("at"), "file_offset", "caplen", F.col("src_ip").alias("packet_src_ip"), "dns_qname", "dns_qtype"]
    for name, (where, key) in scopes(cfg or config.configured()).items():
        own = rows.where(where).select(*slim, key.alias("scope_key"))
        met = alerts.where(F.col("scope") == name).join(own, ["capture_id", "scope_key"]).where(F.col("at") <= F.col("seq"))
        out = met if out is None else out.unionByName(met)
    return out


def dns_telemetry(alerts: DataFrame, packets: DataFrame, cfg: dict | None = None) -> DataFrame:
    """DNS names of packets that alerts refer to: how often (packets of each alert), type, entropy and client of the first, and what
    the last alert says whose last DNS packet has the name. Alerts come in the order of dedup()."""
    rows = bridge(alerts, packets, cfg).where(F.col("dns_qname") != "").withColumn("when", F.struct("place", F.col("at").alias("at")))
    kind = F.coalesce(*(F.when(F.col("dns_qtype") == n, F.lit(t)) for n, t in config.QTYPES), F.concat(F.lit("TYPE-"), F.coalesce(F.col("dns_qtype"), F.lit(1)).cast("string")))
    seen = rows.groupBy("dns_qname").agg(F.count("*").alias("count"), F.min_by(kind, "when").alias("qtype"), F.min_by("packet_src_ip", "when").alias("client_ip"))
    said = F.when(F.col("rule_id").contains("TUNNEL"), "COVERT DNS TUNNELING").when(F.col("rule_id").contains("DGA"), "HIGH ENTROPY / DGA")
    last = rows.groupBy("alert_id", "rule_id", "place").agg(F.max_by("dns_qname", "at").alias("dns_qname")).withColumn("said", said).where("said is not null")
    told = last.groupBy("dns_qname").agg(F.max_by("said", "place").alias("said"))
    out = seen.join(told, "dns_qname", "left").withColumn("threat_status", F.coalesce("said", F.lit("BENIGN"))).drop("said")
    return out.withColumn("entropy", F.round(net.entropy(F.substring_index("dns_qname", ".", 1)), 2)).withColumnRenamed("dns_qname", "domain")


def suspicious_payloads(alerts: DataFrame) -> DataFrame:
    """Requests, credentials and files among the alerts, as rows of one form."""
    kind = (
        F.when(F.col("rule_id").contains("HTTP") | F.col("rule_id").contains("WEB") | F.upper("title").contains("HTTP"), "HTTP")
        .when(F.col("rule_id").contains("CRED") | F.col("title").contains("Credential"), "CRED")
        .when(F.col("rule_id").contains("MAGIC") | F.col("rule_id").contains("CARVE") | F.col("title").contains("File Signature"), "FILE")
    )
    of = lambda path: F.get_json_object("proof", f"$.{path}")
    place = F.concat("target_ip", F.lit(":"), F.col("target_port").cast("string"))
    by = lambda http, cred, file: F.when(F.col("kind") == "HTTP", http).when(F.col("kind") == "CRED", cred).otherwise(file)
    rows = alerts.withColumn("kind", kind).where("kind is not null")
    return rows.select(
        "alert_id", "source_ip", "target_ip", "target_port",
        by(F.concat(F.lit("http://"), place, F.lit("/")), F.concat(F.lower("protocol"), F.lit("://"), place), F.concat(F.lit("tcp://"), place)).alias("url_or_path"),
        by(F.coalesce(of("http_method"), F.lit("GET")), F.lit("AUTH"), F.lit("BINARY TRANSFER")).alias("method"),
        by(F.coalesce(of("user_agent"), F.lit("N/A")), F.lit("N/A"), F.coalesce(of("magic_bytes_hex"), F.lit(""))).alias("user_agent"),
        by(F.col("title"), F.lit("Exposed Cleartext Credentials"), F.concat(F.lit("Cleartext Binary File Transfer ("), F.coalesce(of("detected_file_type"), F.lit("")), F.lit(")"))).alias("threat_category"),
    )


def summary(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: packets, flows, alerts, and alerts by severity."""
    p = packets.agg(F.count("*").alias("total_packets"), F.countDistinct("flow_id").alias("total_flows"))
    a = alerts.agg(F.count("*").alias("total_alerts"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in config.SEVERITIES))
    return p.crossJoin(a)  # one row each


def uuid5(kind: str, alert: Column) -> Column:
    """Id of a STIX object, the same in every run."""
    h = F.sha1(F.concat(F.lit(kind + "|"), alert).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit(kind + "--"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def stix_objects(alerts: DataFrame) -> DataFrame:
    """An indicator, an observation and the relation between them for each alert: id, type and JSON."""
    address = lambda c: F.when(F.col(c).contains(":"), "ipv6-addr").otherwise("ipv4-addr")
    ids = {k: uuid5(k, F.col("alert_id")) for k in ("indicator", "observed-data", "relationship")}
    pattern = F.concat(F.lit("["), address("source_ip"), F.lit(":value = '"), "source_ip", F.lit("']"))
    seen = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    end = lambda c: F.struct(address(c).alias("type"), F.col(c).alias("value"))
    traffic = F.struct(F.lit("network-traffic").alias("type"), F.lit("0").alias("src_ref"), F.lit("1").alias("dst_ref"), F.col("source_port").alias("src_port"), F.col("target_port").alias("dst_port"), F.array(F.lower("protocol")).alias("protocols"))
    version = F.lit("2.1").alias("spec_version")
    indicator = F.to_json(F.struct(F.lit("indicator").alias("type"), version, ids["indicator"].alias("id"), F.col("title").alias("name"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), seen.alias("valid_from")))
    observed = F.to_json(F.struct(F.lit("observed-data").alias("type"), version, ids["observed-data"].alias("id"), seen.alias("first_observed"), seen.alias("last_observed"), F.greatest("packet_count", F.lit(1)).alias("number_observed"), F.struct(end("source_ip").alias("0"), end("target_ip").alias("1"), traffic.alias("2")).alias("objects")))
    relation = F.to_json(F.struct(F.lit("relationship").alias("type"), version, ids["relationship"].alias("id"), F.lit("indicates").alias("relationship_type"), ids["indicator"].alias("source_ref"), ids["observed-data"].alias("target_ref")))
    rows = [F.struct(F.lit(k).alias("type"), ids[k].alias("id"), j.alias("json")) for k, j in (("indicator", indicator), ("observed-data", observed), ("relationship", relation))]
    return alerts.select("alert_id", F.explode(F.array(*rows)).alias("o")).select("alert_id", "o.*")


#: Fields of an alert as a document.
FIELDS = ["alert_id", "rule_id", "title", "description", "severity", "stage", "source_ip", "target_ip", "source_port", "target_port", "protocol", "ts_us", "flow_id", "packet_count"]


def json_lines(alerts: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """alert_id and the alert as JSON: all its fields, the time as ISO 8601, the proof as text; with refs (bridge()) the offsets of its
    packets too."""
    when = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    if refs is not None:
        offsets = refs.groupBy("alert_id").agg(F.array_sort(F.collect_list("file_offset")).alias("packet_offsets"))
        alerts = alerts.join(offsets, "alert_id", "left")
    more = ["packet_offsets"] if refs is not None else []
    return alerts.select("alert_id", F.to_json(F.struct(*FIELDS, when, *more, F.col("proof").alias("arithmetic_proof"))).alias("json"))


def evidence(alerts: DataFrame, packets: DataFrame, cfg: dict | None = None) -> DataFrame:
    """alert_id, capture_id, seq, file_offset and caplen of the packets that each alert refers to; a capture's order is that of offsets."""
    return bridge(alerts, packets, cfg).select("alert_id", "capture_id", F.col("at").alias("seq"), "file_offset", "caplen")


def empty(spark: SparkSession) -> DataFrame:
    form = "alert_id string, rule_id string, title string, description string, severity string, stage string, source_ip string, target_ip string, source_port int, target_port int, protocol string, ts_us long, flow_id string, packet_count long, proof string, detector string, capture_id string, key string, seq long, phase int, module int, scope string, scope_key string"
    return spark.createDataFrame([], form)
