"""Evidence: packets of alerts as capture files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from flowlens.sources.pcap import records

HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def capture_bytes(found: list[tuple[int, int, int, bytes]], link: int = 1) -> bytes:
    """A classic capture of (ts_us, wirelen, caplen, frame)."""
    body = b"".join(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, caplen, wirelen) + frame for ts, wirelen, caplen, frame in found)
    return HEADER[:-4] + struct.pack("<I", link) + body


def frames(files: DataFrame) -> DataFrame:
    """path, file_offset, ts_us, wirelen, caplen, link and frame of every record of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                part: list[tuple] = []
                for _, ts, at, cap, wire, link, frame in records(content):
                    part.append((path, at, ts, wire, cap, link, frame))
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=names)
                        part = []
                yield pd.DataFrame(part, columns=names)

    names = ["path", "file_offset", "ts_us", "wirelen", "caplen", "link", "frame"]
    return files.select("path", "content").mapInPandas(run, "path string, file_offset long, ts_us long, wirelen long, caplen long, link int, frame binary")


def carve(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """alert_id and capture (bytes): records of the files (path, content) that evidence (alert_id, path, file_offset) names, in the
    order of path and offset, once each. Works for classic files and PCAPNG, as frames are read anew. One alert's records are one
    capture, a value of a row; its link type is that of its first record."""
    found = frames(files).join(evidence.select("alert_id", "path", "file_offset").distinct(), ["path", "file_offset"])
    whole = found.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("path", "file_offset", "ts_us", "wirelen", "caplen", "link", "frame"))).alias("f"))

    @F.pandas_udf("binary")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([capture_bytes([(r["ts_us"], r["wirelen"], r["caplen"], bytes(r["frame"])) for r in rows], int(rows[0]["link"])) for rows in s], dtype=object)

    return whole.select("alert_id", written(F.col("f")).alias("capture"))


def enhanced_block(frame: bytes, ts_us: int, comment: str | None = None, order: str = ">", face: int = 0, wirelen: int | None = None) -> bytes:
    """A PCAPNG packet block of an interface, with a comment."""
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    note = comment.encode() if comment else b""
    options = struct.pack(order + "HH", 1, len(note)) + padded(note) + struct.pack(order + "HH", 0, 0) if note else b""
    body = struct.pack(order + "IIIII", face, ts_us >> 32, ts_us & 0xFFFFFFFF, len(frame), len(frame) if wirelen is None else wirelen) + padded(frame) + options
    return struct.pack(order + "II", 6, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


SECTION = struct.pack(">IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)


def interface_block(link: int) -> bytes:
    return struct.pack(">IIHHII", 1, 20, link, 0, 0, 20)


class Written(WriterCommitMessage):
    """Files that a task has written: where they are, and their names."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class CarvedWriter(DataSourceWriter):
    """A capture for each alert. Tasks write into folders of their own below `_tmp-<job>`; commit moves the files of the tasks that
    count to their places, and both commit and abort delete the rest, so a failed task or job leaves nothing behind."""

    def __init__(self, path: str, form: str):
        self.path, self.form, self.job = path, form, f"_tmp-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, rows: Iterator) -> Written:
        """Rows come sorted by alert, path and offset; one record is held at a time."""
        store, base = self._store()
        folder, names, out, alert, faces = f"{base}/{self.job}/{uuid.uuid4().hex}", [], None, None, {}
        store.create_dir(folder)
        for r in rows:
            if r["alert_id"] != alert:
                if out:
                    out.close()
                alert, faces = r["alert_id"], {}
                names.append(f"{alert}.{self.form}")
                out = store.open_output_stream(f"{folder}/{names[-1]}")
                out.write(SECTION if self.form == "pcapng" else capture_bytes([], int(r["link"])))
            frame, ts = bytes(r["frame"]), int(r["ts_us"])
            if self.form == "pcapng":
                if r["link"] not in faces:
                    faces[r["link"]] = len(faces)
                    out.write(interface_block(int(r["link"])))
                out.write(enhanced_block(frame, ts, r["comment"], face=faces[r["link"]], wirelen=int(r["wirelen"])))
            else:
                out.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, int(r["caplen"]), int(r["wirelen"])) + frame)
        if out:
            out.close()
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        store, base = self._store()
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{base}/{name}")
        store.delete_dir(f"{base}/{self.job}")

    def abort(self, messages: list) -> None:
        store, base = self._store()
        if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.job}")


class CarvedSink(DataSource):
    """spark.dataSource.register(CarvedSink); df.write.format("carved").option("form", "pcap" or "pcapng").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "carved"

    def schema(self) -> str:
        return "alert_id string, path string, file_offset long, ts_us long, wirelen long, caplen long, link int, frame binary, comment string"

    def writer(self, schema, overwrite: bool) -> CarvedWriter:
        form = self.options.get("form", "pcap")
        if form not in ("pcap", "pcapng"):
            raise ValueError(f"no such form: {form}")
        return CarvedWriter(self.options["path"].rstrip("/"), form)


def write_carved(files: DataFrame, evidence: DataFrame, folder: str, form: str = "pcap") -> None:
    """Write the records of the files (path, content) that evidence (alert_id, path, file_offset, comment) names, a capture for each
    alert in folder, which all executors and the driver share. An alert of any size is written record by record; with pcapng each packet
    has its comment and its link type, with pcap all have the link type of the first."""
    spark = files.sparkSession
    spark.dataSource.register(CarvedSink)
    named = evidence.select("alert_id", "path", "file_offset", "comment").dropDuplicates(["alert_id", "path", "file_offset"])
    found = frames(files).join(named, ["path", "file_offset"])
    columns = [c.split()[0] for c in CarvedSink({}).schema().split(", ")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = found.select(columns).repartition(parts, "alert_id").sortWithinPartitions("alert_id", "path", "file_offset")
    dealt.write.format("carved").option("form", form).mode("append").save(folder)
