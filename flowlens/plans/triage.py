"""The whole run over a capture: alerts, hosts, telemetry and summary; reports of them."""

from __future__ import annotations

import html
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import VERSION, config
from flowlens.operators import alerts as A
from flowlens.operators import flows
from flowlens.sources import carve
from flowlens.sources.pcap import read_captures
from flowlens.sources.ranges import read_ranges
from flowlens.tables import cut, drop


class Triage(NamedTuple):
    packets: DataFrame
    flows: DataFrame
    alerts: DataFrame
    hosts: DataFrame
    timelines: DataFrame
    dns: DataFrame
    payloads: DataFrame
    evidence: DataFrame
    summary: DataFrame

    def close(self) -> None:
        """Give back the tables that the results share."""
        drop(self.packets, self.alerts)


def triage(packets: DataFrame, rules: dict | None = None, detectors: dict | None = None) -> Triage:
    """All results over packets. Many branches share packets and alerts, so these are written as tables; close() deletes them."""
    cfg = config.configured(rules)
    packets = cut(flows.with_flow(packets))
    alerts = cut(A.dedup(A.union(packets, cfg, detectors)))
    return Triage(packets, flows.aggregate(packets), alerts, A.timelines(alerts), A.timeline_alerts(alerts), A.dns_telemetry(alerts, packets, cfg), A.suspicious_payloads(alerts), A.evidence(alerts, packets, cfg), A.summary(packets, alerts))


def triage_path(spark: SparkSession, path: str, rules: dict | None = None, range_bytes: int | None = None) -> Triage:
    """All results over the captures under a path, each file in a task; with range_bytes each range of so many bytes, for files of any size."""
    return triage(read_captures(spark, path) if range_bytes is None else read_ranges(spark, path, range_bytes), rules)


def carved(spark: SparkSession, run: Triage, alert: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of the captures, and evidence (alert_id, path, file_offset, comment) of all alerts, or of the one with this id."""
    some = run.alerts if alert is None else run.alerts.where(F.col("alert_id") == alert)
    note = F.concat(F.lit("["), "alert_id", F.lit("] "), "rule_id", F.lit(" - "), "title")
    named = run.evidence.join(some.select("alert_id", note.alias("comment")), "alert_id")
    files = spark.read.format("binaryFile").load([r["capture_id"] for r in run.packets.select("capture_id").distinct().collect()])
    return files, named.select("alert_id", F.col("capture_id").alias("path"), "file_offset", "comment")


def write_carved(spark: SparkSession, run: Triage, folder: str, form: str = "pcap", alert: str | None = None) -> None:
    """A capture of its packets for each alert, or for the one with this id."""
    carve.write_carved(*carved(spark, run, alert), folder, form)


def _first(rows: DataFrame, order, most: int, line) -> list[str]:
    """Lines of the first rows of a report, and how many more there are."""
    left = rows.count() - most
    return [line(r) for r in rows.orderBy(order).limit(most).collect()] + ([f"... and {left} more, in the JSON output"] if left > 0 else [])


def text_report(run: Triage, most: int = 50) -> str:
    """Summary, and the first `most` alerts and hosts; a line tells how many more there are."""
    s = run.summary.first().asDict()
    out = ["TRIAGE SUMMARY", ", ".join(f"{k}: {v}" for k, v in s.items()), "", "ALERTS"]
    out += _first(run.alerts, "place", most, lambda r: f"[{r['severity']}] {r['alert_id']} {r['title']}: {r['source_ip']} -> {r['target_ip']}")
    out += ["", "HOSTS"] + _first(run.hosts, F.desc("plausibility_score"), most, lambda r: f"{r['entity_ip']}: {r['plausibility_score']} ({r['chronological_alignment']}) {' > '.join(r['stages_covered'])}")
    return "\n".join(out)


def html_report(run: Triage, most: int = 50) -> str:
    """The text report as a page; everything from a capture is escaped."""
    return f"<!doctype html><meta charset=utf-8><title>Triage</title><pre>{html.escape(text_report(run, most))}</pre>"


def write_json(run: Triage, folder: str) -> None:
    """Alerts with the offsets of their packets, hosts, timelines, telemetry, payloads, summary and metadata as JSON lines in folders."""
    A.json_lines(run.alerts, run.evidence).select("json").write.mode("overwrite").text(f"{folder}/alerts")
    run.summary.select(F.lit("flowlens").alias("tool"), F.lit(VERSION).alias("version"), F.struct("*").alias("summary")).write.mode("overwrite").json(f"{folder}/metadata")
    for name in ("hosts", "timelines", "summary", "dns", "payloads"):
        getattr(run, name).write.mode("overwrite").json(f"{folder}/{name}")


def write_stix(run: Triage, folder: str) -> None:
    """STIX objects, one a line."""
    A.stix_objects(run.alerts).select("json").write.mode("overwrite").text(folder)


def stix_bundle(run: Triage) -> str:
    """One bundle of all objects, for small runs: it is built on the driver. Others take write_stix()."""
    rows = A.stix_objects(run.alerts).collect()
    return json.dumps({"type": "bundle", "id": "bundle--" + rows[0]["id"].split("--")[1] if rows else "bundle--0", "objects": [json.loads(r["json"]) for r in rows]})
