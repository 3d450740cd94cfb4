"""Schemas of captures and packets."""

from __future__ import annotations

TLS = "struct<version:int,ciphers:array<int>,extensions:array<int>,supported_groups:array<int>,ec_point_formats:array<int>,sni:string>"
PACKETS = (
    "capture_id string, seq long, ts_us long, file_offset long, caplen long, wirelen long, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol int, tcp_seq long, tcp_ack long, tcp_flags int, dns_qname string, dns_qtype int, "
    f"tls_info {TLS}, payload binary, payload_len int, decode_error string"
)
