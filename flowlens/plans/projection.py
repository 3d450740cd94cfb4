"""Packets made from the table of events by fixed rules, in Spark and in DuckDB SQL, so that detectors can be checked on tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEACON_BEGIN = 1704067200000000
CIPHERS = [[4865, 4866, 4867], [4865, 49195], [47]]
#: What the first cipher list gives, known as malware in the queries here.
KNOWN_JA3 = hashlib.md5(b"771,4865-4866-4867,0-23-65281,29-23,0").hexdigest()
PURCHASE = [
    "GET /index HTTP/1.1\r\nHost: a\r\nUser-Agent: curl/8.0\r\n\r\n", "GET /up/c99.php?cmd=id HTTP/1.1\r\nHost: a\r\n\r\n", "PUT /file HTTP/1.1\r\nHost: a\r\n\r\n",
    "POST /login HTTP/1.1\r\nAuthorization: Basic dXNlcjpwYXNzMTIz\r\n\r\n",
]
VIEW = ["SMB \\pipe\\svcctl samr", "SMB \\pipe\\lsarpc", "SMB \\\\srv\\\\ADMIN$", "x", "SMB \\\\\\c$ ipc$"]
CLICK = ["MZ program", "%PDF-1.7", "", "ab 7z", "plain"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, et, u, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_type"), F.col("user_id"), F.col("event_id")
    periodic = (et == "error") & (u % 10 == 0)
    turn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    ts = F.when(periodic, F.lit(BEACON_BEGIN) + turn * 30_000_000 + (k % 3) * 1_000_000).otherwise(F.unix_micros(F.col("ts").cast("timestamp")))
    pick = lambda rows, n: F.coalesce(*(F.when(k % n == i, F.lit(r)) for i, r in enumerate(rows)))
    case = lambda **by: F.coalesce(*(F.when(et == name, value) for name, value in by.items()))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s = lambda c: c.cast("string")
    h = F.md5(s(seq).cast("binary"))
    name = F.when(k % 4 == 0, text(F.substring(h, 1, 16), ".eval.example.com")).when(k % 4 == 1, "_ldap._tcp.dc._msdcs.corp.internal").when(k % 4 == 2, text("d", s(seq), ".verylongencodedpayloadchunk", s(seq * 1000), ".covert", s(k % 7), ".org")).otherwise("www.example.net")
    payload = case(purchase=pick(PURCHASE, 4), view=pick(VIEW, 5), click=pick(CLICK, 5))
    tls = F.when((et == "error") & (k % 2 == 0), F.struct(
        F.lit(771).alias("version"), F.coalesce(*(F.when(k % 3 == i, F.array(*map(F.lit, c))) for i, c in enumerate(CIPHERS))).alias("ciphers"), F.array(*map(F.lit, (0, 23, 65281))).alias("extensions"),
        F.array(F.lit(29), F.lit(23)).alias("supported_groups"), F.array(F.lit(0)).alias("ec_point_formats"), F.when(k % 4 == 0, "evil.example").alias("sni"),
    ))
    base = e.select(
        F.lit("events").alias("capture_id"), seq.alias("seq"), ts.cast("long").alias("ts_us"), (24 + seq * 80).alias("file_offset"), F.lit(64).cast("long").alias("caplen"),
        (60 + F.round(F.col("value") * 100)).cast("long").alias("wirelen"), text("10.0.", s(u % 4), ".", s(1 + u % 250)).alias("a_ip"), (1024 + u).cast("int").alias("a_port"),
        case(view=text("10.1.0.", s(1 + k)), click=text("10.1.0.", s(1 + k)), signup=F.lit("10.0.0.53"), error=F.lit("198.51.100.7"), purchase=text("198.51.100.", s(1 + k % 20))).alias("b_ip"),
        case(view=F.lit(445), click=F.lit(3389), purchase=F.lit(80), error=F.lit(443), signup=F.lit(53)).alias("b_port"), F.when(et == "signup", 17).otherwise(6).alias("protocol"),
        F.when(et == "view", 2).when(et == "click", pick([0, 41, 1, 19, 24], 5)).when(et == "signup", 0).otherwise(24).alias("tcp_flags"),
        F.when(et == "signup", name).alias("dns_qname"), F.when(et == "signup", F.when(k % 4 == 2, 16).otherwise(1)).alias("dns_qtype"), tls.alias("tls_info"),
        payload.cast("binary").alias("payload"), F.coalesce(F.length(payload), F.lit(0)).alias("payload_len"), ((et == "error") & (seq % 7 == 0)).alias("reply"),
    )
    turned = lambda a, b: F.when(F.col("reply"), F.col(b)).otherwise(F.col(a))
    ends = {"src_ip": turned("a_ip", "b_ip"), "dst_ip": turned("b_ip", "a_ip"), "src_port": turned("a_port", "b_port"), "dst_port": turned("b_port", "a_port")}
    return base.withColumns(ends).drop("a_ip", "b_ip", "a_port", "b_port", "reply")


def _text(value: str) -> str:
    quoted = value.replace("'", "''")
    return "('" + quoted.replace("\r\n", "' || chr(13) || chr(10) || '") + "')"


def _pick(rows: list, n: int) -> str:
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {_text(r) if isinstance(r, str) else r}" for i, r in enumerate(rows)) + " END"


PACKETS_SQL = f"""
e AS (SELECT event_id AS seq, ts, user_id AS u, event_type AS et, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, md5(CAST(event_id AS VARCHAR)) AS h,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events),
b AS (SELECT 'events' AS capture_id, seq, u, k, et,
  CAST(CASE WHEN et = 'error' AND u % 10 = 0 THEN {BEACON_BEGIN} + turn * 30000000 + (k % 3) * 1000000 ELSE epoch_us(ts) END AS BIGINT) AS ts_us,
  24 + seq * 80 AS file_offset, CAST(64 AS BIGINT) AS caplen, CAST(60 + round(value * 100) AS BIGINT) AS wirelen,
  '10.0.' || (u % 4) || '.' || (1 + u % 250) AS a_ip, CAST(1024 + u AS INTEGER) AS a_port,
  CASE et WHEN 'view' THEN '10.1.0.' || (1 + k) WHEN 'click' THEN '10.1.0.' || (1 + k) WHEN 'signup' THEN '10.0.0.53' WHEN 'error' THEN '198.51.100.7' WHEN 'purchase' THEN '198.51.100.' || (1 + k % 20) END AS b_ip,
  CASE et WHEN 'view' THEN 445 WHEN 'click' THEN 3389 WHEN 'purchase' THEN 80 WHEN 'error' THEN 443 WHEN 'signup' THEN 53 END AS b_port,
  CASE WHEN et = 'signup' THEN 17 ELSE 6 END AS protocol,
  CASE et WHEN 'view' THEN 2 WHEN 'click' THEN CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 41 WHEN 2 THEN 1 WHEN 3 THEN 19 ELSE 24 END WHEN 'signup' THEN 0 ELSE 24 END AS tcp_flags,
  CASE WHEN et = 'signup' THEN CASE k % 4 WHEN 0 THEN substr(h, 1, 16) || '.eval.example.com' WHEN 1 THEN '_ldap._tcp.dc._msdcs.corp.internal'
    WHEN 2 THEN 'd' || seq || '.verylongencodedpayloadchunk' || (seq * 1000) || '.covert' || (k % 7) || '.org' ELSE 'www.example.net' END END AS dns_qname,
  CASE WHEN et = 'signup' THEN CASE WHEN k % 4 = 2 THEN 16 ELSE 1 END END AS dns_qtype,
  CASE WHEN et = 'error' AND k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN [4865, 4866, 4867] WHEN 1 THEN [4865, 49195] ELSE [47] END END AS ciphers,
  CASE WHEN et = 'error' AND k % 4 = 0 THEN 'evil.example' END AS sni,
  CASE et WHEN 'purchase' THEN {_pick(PURCHASE, 4)} WHEN 'view' THEN {_pick(VIEW, 5)} WHEN 'click' THEN {_pick(CLICK, 5)} END AS payload,
  et = 'error' AND seq % 7 = 0 AS reply FROM e),
q AS (SELECT *, CASE WHEN reply THEN b_ip ELSE a_ip END AS src_ip, CASE WHEN reply THEN a_ip ELSE b_ip END AS dst_ip,
  CASE WHEN reply THEN b_port ELSE a_port END AS src_port, CASE WHEN reply THEN a_port ELSE b_port END AS dst_port, coalesce(length(payload), 0) AS payload_len FROM b),
o AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS up FROM q),
p AS (SELECT *, CASE WHEN up THEN src_ip ELSE dst_ip END AS ea_ip, CASE WHEN up THEN src_port ELSE dst_port END AS ea_port,
  CASE WHEN up THEN dst_ip ELSE src_ip END AS eb_ip, CASE WHEN up THEN dst_port ELSE src_port END AS eb_port,
  protocol || ':' || CASE WHEN up THEN src_ip || ':' || src_port || '<->' || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || '<->' || src_ip || ':' || src_port END AS flow_id FROM o)
"""


def with_packets(sql: str, *more: str) -> str:
    """DuckDB SQL over p, the packets with flow_id and ends; more: further tables of the WITH clause."""
    return "WITH " + ",".join([PACKETS_SQL, *more]) + "\n" + sql
