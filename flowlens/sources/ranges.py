"""Captures of any size, read by ranges of bytes.

A first job looks at every range: it finds where a record begins by a chain of plausible headers, and walks to the first record
behind the range. The driver follows the chain from range to range, a row for each; where a range guessed wrong it is walked again
from where the one before it ended, so a record is never lost or made up. A second job decodes each range from its exact begin,
with the numbers that its records have in the file. PCAPNG ranges get the section and interface blocks that stand before them.

Files are opened by pyarrow's file systems; for stores that only Spark reads there is pcap.read_captures. Records that are cut off
end a file. An empty file, or one that is no capture, is an error.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas
from flowlens.sources.pcap import COLUMNS, ENHANCED, INTERFACE, MAGIC, SECTION, SIMPLE, records, rows

RANGE_BYTES = 64 << 20
CHAIN, LONGEST, OVER = 6, 1 << 26, 1 << 62
WALKED = "path string, begin long, start long, leave long, records long, order string, faces array<struct<at:long,raw:binary>>"


def opened(path: str) -> io.BufferedReader:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def _at(f: io.BufferedReader, place: int, size: int) -> bytes:
    f.seek(place)
    return f.read(size)


def byte_order(head: bytes) -> str:
    if head[:4] == SECTION.to_bytes(4, "big") and len(head) >= 12:
        return ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else "<"
    if head[:4] not in MAGIC or len(head) < 24:
        raise ValueError("not a capture file")
    return MAGIC[head[:4]][0]


def step(f: io.BufferedReader, place: int, length: int, order: str, blocks: bool, nano: bool) -> int:
    """Bytes of the record or block at this place; 0: there is none that is whole and plausible."""
    head = _at(f, place, 16)
    if blocks:
        if len(head) < 12:
            return 0
        size = struct.unpack(order + "I", head[4:8])[0]
        return size if 12 <= size <= LONGEST and size % 4 == 0 and place + size <= length and _at(f, place + size - 4, 4) == head[4:8] else 0
    if len(head) < 16:
        return 0
    _, part, caplen, wirelen = struct.unpack(order + "IIII", head)
    fine = part < (1_000_000_000 if nano else 1_000_000) and caplen <= min(LONGEST, max(wirelen, 1))
    return 16 + caplen if fine and place + 16 + caplen <= length else 0


def synchronised(f: io.BufferedReader, begin: int, end: int, length: int, order: str, blocks: bool, nano: bool) -> int:
    """The first place from begin at which a chain of records starts; OVER: none before end."""
    for place in range(begin + (-begin % 4 if blocks else 0), end, 4 if blocks else 1):
        at = place
        for _ in range(CHAIN):
            size = step(f, at, length, order, blocks, nano)
            at += size
            if not size or at == length:
                break
        if size:
            return place
    return OVER


def walked(f: io.BufferedReader, start: int, end: int, length: int, order: str, blocks: bool) -> tuple[int, int, str, list]:
    """From start: where the first record behind the range begins, how many records are before it, the byte order there, and section and
    interface blocks on the way. Lengths alone count, so that this goes where records() goes."""
    at, count, faces = start, 0, []
    while at < end:
        head = _at(f, at, 16)
        if blocks:
            if len(head) < 12:
                return OVER, count, order, faces
            kind = struct.unpack(order + "I", head[:4])[0]
            if head[:4] == SECTION.to_bytes(4, "big"):
                order, kind = byte_order(head), SECTION
            size = struct.unpack(order + "I", head[4:8])[0]
            if size < 12 or at + size > length:
                return OVER, count, order, faces
            if kind in (SECTION, INTERFACE):
                faces.append({"at": at, "raw": _at(f, at, size)})
            count += (kind == ENHANCED and size >= 32) or (kind == SIMPLE and size >= 16)
        else:
            size = 16 + struct.unpack(order + "IIII", head)[2] if len(head) == 16 else 0
            if not size or at + size > length:
                return OVER, count, order, faces
            count += 1
        at += size
    return at, count, order, faces


def looked_at(ranges: DataFrame) -> DataFrame:
    """WALKED rows of ranges (path, length, begin, end, start, order); start null: to be found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                with opened(r.path) as f:
                    head = _at(f, 0, 24)
                    blocks, order = head[:4] == SECTION.to_bytes(4, "big"), byte_order(head) if pd.isna(r.order) else r.order
                    nano = not blocks and MAGIC[head[:4]][1] > 1
                    first = 0 if blocks else 24
                    start = int(r.start) if not pd.isna(r.start) else first if r.begin == 0 else synchronised(f, max(int(r.begin), first), int(r.end), int(r.length), order, blocks, nano)
                    leave, count, after, faces = walked(f, start, int(r.end), int(r.length), order, blocks) if start < OVER else (OVER, 0, order, [])
                    out.append((r.path, r.begin, start, leave, count, after, faces))
            yield pd.DataFrame(out, columns=["path", "begin", "start", "leave", "records", "order", "faces"])

    return ranges.select("path", "length", "begin", "end", "start", "order").mapInPandas(run, WALKED)


def chained(found: list, ends: dict) -> tuple[list[dict], list[dict]]:
    """Ranges to read, with exact begins and numbers, and those to be walked again. found: WALKED rows; ends: (path, begin) -> (end, length)."""
    read, again, by = [], [], {}
    for r in sorted(found, key=lambda r: (r["path"], r["begin"])):
        by.setdefault(r["path"], []).append(r)
    for path, own in by.items():
        place, number, faces, order = own[0]["start"], 0, [], own[0]["order"]
        for r in own:
            end, length = ends[path, r["begin"]]
            if place >= end:
                continue  # one record covers the range, or the file is over
            if r["start"] != place:
                again.append({"path": path, "length": length, "begin": r["begin"], "end": end, "start": place, "order": order})
                break  # what comes behind is not known yet
            read.append({"path": path, "start": place, "leave": min(r["leave"], length), "number": number, "before": b"".join(faces)})
            for face in r["faces"]:
                faces = ([] if face["raw"][:4] == SECTION.to_bytes(4, "big") else faces) + [bytes(face["raw"])]
            place, number, order = r["leave"], number + r["records"], r["order"]
    return read, again


def read_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """Packets of all captures under a path, as pcap.read_captures() gives them, with one task for each `size` bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.select("path", "length", F.explode(begins).alias("begin")).withColumns({"end": F.least(F.col("begin") + size, "length"), "start": F.lit(None).cast("long"), "order": F.lit(None).cast("string")})
    todo = ranges.collect()  # a row for each range
    ends = {(r["path"], r["begin"]): (r["end"], r["length"]) for r in todo}
    form = ranges.schema
    deal = lambda plan, schema: spark.createDataFrame(plan, schema).repartition(max(len(plan), 1))
    found = {(r["path"], r["begin"]): r for r in looked_at(deal(todo, form)).collect()}
    while True:
        read, again = chained(list(found.values()), ends)
        if not again:
            break
        found |= {(r["path"], r["begin"]): r for r in looked_at(deal([tuple(x[c] for c in form.names) for x in again], form)).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                with opened(r.path) as f:
                    before = bytes(r.before) or (b"" if r.start == 0 else _at(f, 0, 24))
                    data = before + _at(f, int(r.start), int(r.leave - r.start))
                moved = ((r.number + n, ts, at - len(before) + r.start, cap, wire, link, frame) for n, ts, at, cap, wire, link, frame in records(data))
                part = []
                for row in rows(r.path, moved):
                    part.append(row)
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=COLUMNS, dtype=object)
                        part = []
                yield pd.DataFrame(part, columns=COLUMNS, dtype=object)

    columns = "path string, start long, leave long, number long, before binary"
    return deal([tuple(x[c.split()[0]] for c in columns.split(", ")) for x in read], columns).mapInPandas(run, schemas.PACKETS)
