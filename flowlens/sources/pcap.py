"""Capture files as DataFrames of packets.

`read_captures` takes files through Spark's binaryFile reader, so from any store, and works on a stream of files too; each
file is one record. For files too large for that, the data source "capture" walks a file's record headers once and gives
ranges of records to tasks. Both yield the columns of schemas.PACKETS.

Classic captures come in both byte orders, in micro- or nanoseconds; PCAPNG with sections, interfaces (time resolution
read), enhanced and simple packets. A record cut off at the end of a file ends it. A frame that can't be decoded is left out;
a TLS or DNS part that can't be read leaves the packet, with decode_error set.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens import schemas

# Magic numbers, block and link types of capture files.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
NULL, ETHERNET, RAW, LINUX_SLL = 0, 1, 101, 113
IPV4, IPV6, ARP, TAGS = 0x0800, 0x86DD, 0x0806, (0x8100, 0x88A8)
COLUMNS = [c.split()[0] for c in schemas.PACKETS.replace(schemas.TLS, "x").split(", ")]
RECORDS = 100_000


def records(data: bytes, first: int = 0, most: int | None = None, begin: int | None = None) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """seq, ts_us, file offset, caplen, wirelen, link type and frame of each record."""
    if data[:4] == SECTION.to_bytes(4, "big"):
        yield from _blocks(data)
        return
    if data[:4] not in MAGIC or len(data) < 24:
        raise ValueError("not a capture file")
    order, unit = MAGIC[data[:4]]
    link = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF
    at, seq = (24 if begin is None else begin), first
    while at + 16 <= len(data) and (most is None or seq < first + most):
        sec, part, caplen, wirelen = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + caplen > len(data):
            return
        yield seq, sec * 1_000_000 + part // unit, at, caplen, wirelen, link, data[at + 16 : at + 16 + caplen]
        at, seq = at + 16 + caplen, seq + 1


def _blocks(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    at, seq, order, links = 0, 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == SECTION.to_bytes(4, "big"):
            order, links = (">" if data[at + 8 : at + 12] == b"\x1a\x2b\x3c\x4d" else "<"), []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == INTERFACE and len(body) >= 8:
            links.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order), struct.unpack_from(order + "I", body, 4)[0]))
        elif kind == ENHANCED and len(body) >= 20:
            face, high, low, caplen, wirelen = struct.unpack_from(order + "IIIII", body)
            link, ticks, _ = links[face] if face < len(links) else (ETHERNET, 1_000_000, 0)
            yield seq, (high << 32 | low) * 1_000_000 // ticks, at, caplen, wirelen, link, body[20 : 20 + caplen]
            seq += 1
        elif kind == SIMPLE and len(body) >= 4:
            wirelen = struct.unpack_from(order + "I", body)[0]
            link, _, snap = links[0] if links else (ETHERNET, 1_000_000, 0)
            caplen = min(wirelen, snap or wirelen, len(body) - 4)
            yield seq, 0, at, caplen, wirelen, link, body[4 : 4 + caplen]
            seq += 1
        at += size


def _resolution(options: bytes, order: str) -> int:
    """Ticks in a second."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def decode(frame: bytes, link: int) -> dict | None:
    """Header fields of a frame; None if it holds no whole packet of a known kind."""
    kind, at = _network(frame, link)
    if kind == ARP and len(frame) >= at + 28:
        return _packet(str(ipaddress.IPv4Address(frame[at + 14 : at + 18])), str(ipaddress.IPv4Address(frame[at + 24 : at + 28])), ARP, b"")
    if kind == IPV4 and len(frame) >= at + 20:
        size = (frame[at] & 15) * 4
        if size < 20 or len(frame) < at + size:
            return None
        ends = [str(ipaddress.IPv4Address(frame[at + i : at + i + 4])) for i in (12, 16)]
        return _transport(frame[at + size :], frame[at + 9], *ends)
    if kind == IPV6 and len(frame) >= at + 40:
        ends = [ipaddress.IPv6Address(frame[at + i : at + i + 16]).compressed for i in (8, 24)]
        return _transport(frame[at + 40 :], frame[at + 6], *ends)
    return None


def _network(frame: bytes, link: int) -> tuple[int, int]:
    """Kind of the network header and where it begins."""
    if link == ETHERNET:
        at = 12
        while at + 2 <= len(frame) and int.from_bytes(frame[at : at + 2], "big") in TAGS:
            at += 4
        return int.from_bytes(frame[at : at + 2], "big"), at + 2
    if link == LINUX_SLL:
        return int.from_bytes(frame[14:16], "big"), 16
    at = 4 if link == NULL else 0
    return {4: IPV4, 6: IPV6}.get(frame[at] >> 4 if len(frame) > at else 0, 0), at


def _packet(src: str, dst: str, protocol: int, payload: bytes, src_port: int = 0, dst_port: int = 0, **more) -> dict:
    base = {"tcp_seq": 0, "tcp_ack": 0, "tcp_flags": 0, "dns_qname": None, "dns_qtype": None, "tls_info": None, "decode_error": None}
    return base | {"src_ip": src, "dst_ip": dst, "src_port": src_port, "dst_port": dst_port, "protocol": protocol, "payload": payload, "payload_len": len(payload)} | more


def _transport(body: bytes, protocol: int, src: str, dst: str) -> dict | None:
    if protocol == 6:
        if len(body) < 20:
            return None
        a, b, seq, ack, flags = struct.unpack_from(">HHIIH", body)
        payload = body[max(20, (flags >> 12) * 4) :]
        out = _packet(src, dst, 6, payload, a, b, tcp_seq=seq, tcp_ack=ack, tcp_flags=flags & 0x1FF)
        return _read(out, "tls_info", client_hello, payload) if 443 in (a, b) or payload[:1] == b"\x16" else out
    if protocol == 17:
        if len(body) < 8:
            return None
        a, b = struct.unpack_from(">HH", body)
        out = _packet(src, dst, 17, body[8:], a, b)
        return _read(out, "dns", question, body[8:]) if 53 in (a, b) else out
    if protocol in (1, 58) and len(body) >= 2:
        return _packet(src, dst, protocol, b"", body[0], body[1])
    return _packet(src, dst, protocol, body)


def _read(out: dict, field: str, parse, payload: bytes) -> dict:
    try:
        value = parse(payload)
    except (struct.error, IndexError, ValueError) as e:
        return out | {"decode_error": f"{field}: {e}"}
    return out | (dict(zip(("dns_qname", "dns_qtype"), value or (None, None), strict=True)) if field == "dns" else {field: value})


def question(payload: bytes) -> tuple[str, int] | None:
    """Name and type of the first question of a DNS message."""
    if len(payload) < 12 or not int.from_bytes(payload[4:6], "big"):
        return None
    labels, at, after, seen = [], 12, None, set()
    while payload[at]:
        if payload[at] >= 0xC0:
            if at in seen:
                raise ValueError("compression loop")
            seen.add(at)
            after = at + 2 if after is None else after
            at = int.from_bytes(payload[at : at + 2], "big") & 0x3FFF
        else:
            labels.append(payload[at + 1 : at + 1 + payload[at]].decode("ascii", "replace"))
            at += 1 + payload[at]
    after = at + 1 if after is None else after
    return ".".join(labels), struct.unpack_from(">H", payload, after)[0]


def client_hello(payload: bytes) -> dict | None:
    """Version, ciphers, extensions, groups, point formats and server name of a TLS Client Hello in one segment."""
    if len(payload) < 43 or payload[0] != 0x16 or payload[5] != 1:
        return None
    numbers = lambda raw: [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
    out = {"version": int.from_bytes(payload[9:11], "big"), "ciphers": [], "extensions": [], "supported_groups": [], "ec_point_formats": [], "sni": None}
    at = 43 + 1 + payload[43]
    size = struct.unpack_from(">H", payload, at)[0]
    out["ciphers"] = numbers(payload[at + 2 : at + 2 + size])
    at += 2 + size
    at += 1 + payload[at]
    if at + 2 > len(payload):
        return out
    end = min(len(payload), at + 2 + struct.unpack_from(">H", payload, at)[0])
    at += 2
    while at + 4 <= end:
        kind, size = struct.unpack_from(">HH", payload, at)
        body = payload[at + 4 : at + 4 + size]
        out["extensions"].append(kind)
        if kind == 0 and len(body) >= 5:
            out["sni"] = body[5 : 5 + int.from_bytes(body[3:5], "big")].decode("ascii", "replace")
        elif kind == 10:
            out["supported_groups"] = numbers(body[2:])
        elif kind == 11:
            out["ec_point_formats"] = list(body[1:])
        at += 4 + size
    return out


def rows(name: str, found: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of schemas.PACKETS from records that can be decoded; numbers run over all records."""
    for seq, ts, offset, caplen, wirelen, link, frame in found:
        if (p := decode(frame, link)) is not None:
            yield tuple((p | {"capture_id": name, "seq": seq, "ts_us": ts, "file_offset": offset, "caplen": caplen, "wirelen": wirelen})[c] for c in COLUMNS)


def packets_of(files: DataFrame) -> DataFrame:
    """Packets of a DataFrame (or stream) of binary files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                part = []
                for row in rows(path, records(content)):
                    part.append(row)
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=COLUMNS, dtype=object)
                        part = []
                yield pd.DataFrame(part, columns=COLUMNS, dtype=object)

    return files.select("path", "content").mapInPandas(run, schemas.PACKETS)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return packets_of(spark.read.format("binaryFile").load(path))


def stream_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of capture files as they come into a folder, as a capture tool with rolling files writes them."""
    form = "path string, modificationTime timestamp, length long, content binary"
    return packets_of(spark.readStream.format("binaryFile").schema(form).load(folder))


class Range(InputPartition):
    def __init__(self, begin: int, first: int, count: int):
        self.begin, self.first, self.count = begin, first, count


class CaptureReader(DataSourceReader):
    """Ranges of a classic capture that driver and executors can both open."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        with open(self.path, "rb") as f:
            head = f.read(24)
            if head[:4] not in MAGIC:
                return [Range(-1, 0, 0)]
            order, at, seq, out = MAGIC[head[:4]][0], 24, 0, []
            size = f.seek(0, 2)
            while at + 16 <= size:
                f.seek(at)
                caplen = struct.unpack(order + "IIII", f.read(16))[2]
                if at + 16 + caplen > size:
                    break
                if seq % RECORDS == 0:
                    out.append(Range(at, seq, 0))
                out[-1].count += 1
                at, seq = at + 16 + caplen, seq + 1
        return out or [Range(24, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            if partition.begin < 0:
                yield from rows(self.path, records(f.read()))
                return
            head = f.read(24)
            f.seek(partition.begin)
            order, unit = MAGIC[head[:4]]
            link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF

            def found() -> Iterator[tuple]:
                at = partition.begin
                for k in range(partition.count):
                    sec, part, caplen, wirelen = struct.unpack(order + "IIII", f.read(16))
                    yield partition.first + k, sec * 1_000_000 + part // unit, at, caplen, wirelen, link, f.read(caplen)
                    at += 16 + caplen

            yield from rows(self.path, found())


class CaptureSource(DataSource):
    """spark.dataSource.register(CaptureSource); spark.read.format("capture").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return schemas.PACKETS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"])
