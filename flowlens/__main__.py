"""python -m flowlens CAPTURE [--rules FILE] [--capacity N] [--json FOLDER] [--stix FOLDER] [--html FILE] [--carve-all FOLDER [--carve-form FORM] [--alert ID]] [--version]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from flowlens import VERSION
from flowlens.operators import flows
from flowlens.plans import triage as T
from flowlens.sources import rules


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("flowlens")
    parser.add_argument("capture")
    for name in ("--rules", "--json", "--stix", "--html", "--carve-all"):
        parser.add_argument(name)
    parser.add_argument("--carve-form", choices=["pcap", "pcapng"], default="pcap", help="pcapng: each packet says which alert it is of")
    parser.add_argument("--alert", help="carve this alert alone")
    parser.add_argument("--capacity", type=int, help="also count the flows that a flow table of this capacity would open")
    parser.add_argument("--range-bytes", type=int, help="read captures by ranges of this size, for files of any size")
    parser.add_argument("--version", action="version", version=f"flowlens {VERSION}")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("flowlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run = T.triage_path(spark, a.capture, rules.load(a.rules) if a.rules else None, a.range_bytes)
        print(T.text_report(run))
        if a.capacity is not None:
            opened = flows.instances(run.packets, a.capacity).select("capture_id", "flow_id", "flow_instance").distinct().count()
            print(f"\nFLOWS OPENED by a table of {a.capacity}: {opened}")
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.json:
        T.write_json(run, a.json)
    if a.stix:
        T.write_stix(run, a.stix)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(T.html_report(run))
    if a.carve_all:
        T.write_carved(spark, run, a.carve_all, a.carve_form, a.alert)
    return 0


if __name__ == "__main__":
    sys.exit(main())
