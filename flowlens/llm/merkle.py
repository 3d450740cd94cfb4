"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line feed, and its node the BLAKE2 hash of its bytes; sections and the root hash their children.
A section ends at a paragraph chosen by its last span's hash (one in SECTION_PARAGRAPHS). In a paragraph, spans end at words
chosen by their hash (one in SPAN_WORDS), so that all cuts move with the text. Every byte of a text belongs to one span, one
paragraph and one section.

The fingerprint is text: the root, a colon, and the sections, each followed by "/": NODE_HEX digits of its hash, and its paragraphs,
each followed by ".": NODE_HEX digits and SPAN_HEX for each span. Equal texts have equal fingerprints, and roots test equality.

Two trees are compared from the root down. Equal nodes are passed over; the children of others are lined up, in order: what they
begin and end with in common, then children that both have once, as many as keep their order, and what is equal beside these. The
runs between them are the differing branches, and are gone into, down to spans. So edits are located, and likeness is the
share of spans passed over (twice these by all of both), 1 for equal roots; what moved past something else is not passed over.

Null texts count as empty; an empty text has one empty span. Rows that are equal in id come in the order of their text
hashes, a null id last; ids are of any type that can be ordered, numbers by size, texts by code points. Repeated rows give repeated
results; an empty table gives none; other columns don't matter. Rows are dealt by ranges of ids, one id's by ranges of text hashes,
one text's by lot, of about PART_BYTES each, but no more than MOST_PARTS, as a task takes its range in batches. Every task leaves its
first and last row beside its results, and the last row of each meets the first of the next in a join of as many rows as there are tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from flowlens.llm._spark import cut
from flowlens.llm._text import hash_runs, words

SPAN_WORDS, SECTION_PARAGRAPHS, SPAN_HEX, NODE_HEX = 4, 8, 6, 8
DOCS_AT_ONCE = 256
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 14

_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Paragraph(NamedTuple):
    node: int
    spans: tuple[int, ...]

    @property
    def size(self) -> int:
        return len(self.spans)


class Section(NamedTuple):
    node: int
    paragraphs: tuple[Paragraph, ...]

    @property
    def size(self) -> int:
        return sum(len(p.spans) for p in self.paragraphs)


class Tree(NamedTuple):
    root: str
    sections: tuple[Section, ...]

    @property
    def size(self) -> int:
        return sum(s.size for s in self.sections)

    def text(self) -> str:
        body = "".join(f"{s.node:0{NODE_HEX}x}" + "".join(f"{p.node:0{NODE_HEX}x}" + "".join([f"{x:0{SPAN_HEX}x}" for x in p.spans]) + "." for p in s.paragraphs) + "/" for s in self.sections)
        return f"{self.root}:{body}"


def read(fingerprint: str) -> Tree:
    """The tree of a fingerprint."""
    root, body = fingerprint.split(":")
    sections = []
    for part in body.split("/")[:-1]:
        inner = [Paragraph(int(p[:NODE_HEX], 16), tuple(int(p[i : i + SPAN_HEX], 16) for i in range(NODE_HEX, len(p), SPAN_HEX))) for p in part[NODE_HEX:].split(".")[:-1]]
        sections.append(Section(int(part[:NODE_HEX], 16), tuple(inner)))
    return Tree(root, tuple(sections))


def _hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def trees(texts: list[str | None]) -> list[Tree]:
    out = []
    for w in words(texts):
        last_of_doc = w.begin[1:]
        ends = np.unique(np.concatenate([w.end[w.key % np.uint64(SPAN_WORDS) == 0], np.flatnonzero(w.buf == 0x0A) + 1, last_of_doc]))
        start = np.concatenate([[0], ends[:-1]])
        span = hash_runs(w.buf, start, ends, _VALUES)
        last = np.isin(ends, last_of_doc)
        stops = np.flatnonzero((w.buf[ends - 1] == 0x0A) | last)  # last spans of paragraphs
        closes = (last | (span % np.uint64(SECTION_PARAGRAPHS) == 0))[stops]
        short, raw = (span & np.uint64((1 << 4 * SPAN_HEX) - 1)).tolist(), w.buf.tobytes()
        at, sections, paragraphs, nodes, section_nodes = 0, [], [], [], []
        ends_, final = ends.tolist(), last[stops].tolist()
        begin = 0
        for k, (stop, close) in enumerate(zip(stops.tolist(), closes.tolist(), strict=True)):
            end = ends_[stop] - final[k]  # without the space that ends a document in the buffer
            nodes.append(_hash(raw[begin:end]))
            paragraphs.append(Paragraph(int.from_bytes(nodes[-1][: NODE_HEX // 2], "big"), tuple(short[at : stop + 1])))
            at, begin = stop + 1, ends_[stop]
            if close:
                section_nodes.append(_hash(b"".join(nodes)))
                sections.append(Section(int.from_bytes(section_nodes[-1][: NODE_HEX // 2], "big"), tuple(paragraphs)))
                paragraphs, nodes = [], []
            if final[k]:
                out.append(Tree(_hash(b"".join(section_nodes)).hex(), tuple(sections)))
                sections, section_nodes = [], []
    return out


def lined_up(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal values in both, in order: common ends, then values that occur once in both, as many as rise, and equal ones beside them."""
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        once_x, once_y = Counter(x), Counter(y)
        place = {v: j for j, v in enumerate(y) if once_y[v] == 1}
        both = [(i, place[v]) for i, v in enumerate(x) if once_x[v] == 1 and v in place]
        i, j = 0, 0  # what is not yet taken
        for p, q in [*rising(both), (len(x), len(y))]:
            if p < i or q < j:
                continue
            back = []
            while p - 1 - len(back) >= i and q - 1 - len(back) >= j and x[p - 1 - len(back)] == y[q - 1 - len(back)]:
                back.append((p - 1 - len(back), q - 1 - len(back)))
            pairs += [(head + u, head + v) for u, v in reversed(back)]
            i, j = p, q
            while i < len(x) and j < len(y) and x[i] == y[j]:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
    return pairs + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second rises."""
    ends, at, before = [], [], [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        place = bisect_left(ends, q)
        before[k] = at[place - 1] if place else -1
        ends[place : place + 1], at[place : place + 1] = [q], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs i to j of one and k to l of the other between pairs."""
    i = k = 0
    for j, q in [*pairs, (n, m)]:
        if i < j or k < q:
            yield i, j, k, q
        i, k = j + 1, q + 1


def _children(nodes: tuple) -> list:
    return [c for s in nodes for c in (s.paragraphs if isinstance(s, Section) else s.spans)]


def compared(a: tuple, b: tuple, at: tuple[int, int] = (0, 0), branches: list | None = None) -> int:
    """Spans in common of two runs of sections, paragraphs or spans, from the top down; branches: takes in differing runs of paragraphs."""
    inner = bool(a or b) and not isinstance((a or b)[0], int)
    same = lined_up([x.node for x in a], [x.node for x in b]) if inner else lined_up(list(a), list(b))
    if not inner:
        return len(same)
    common = sum(a[i].size for i, _ in same)
    deeper = isinstance((a or b)[0], Section)
    for i, j, k, m in gaps(same, len(a), len(b)):
        before = [at[0] + (sum(len(s.paragraphs) for s in a[:i]) if deeper else i), at[1] + (sum(len(s.paragraphs) for s in b[:k]) if deeper else k)] if branches is not None else (0, 0)
        if branches is not None and not deeper:
            branches.append((before[0], before[0] + j - i, before[1], before[1] + m - k))
        if i < j and k < m:
            common += compared(tuple(_children(a[i:j])), tuple(_children(b[k:m])), tuple(before), branches if deeper else None)
        elif branches is not None and deeper:
            branches.append((before[0], before[0] + len(_children(a[i:j])), before[1], before[1] + len(_children(b[k:m]))))
    return common


def likeness(a: Tree | str, b: Tree | str) -> float:
    """Share of spans in common of two trees or fingerprints."""
    a, b = (read(x) if isinstance(x, str) else x for x in (a, b))
    return 1.0 if a.root == b.root else 2 * compared(a.sections, b.sections) / (a.size + b.size)


def edits(a: Tree | str, b: Tree | str) -> list[tuple[int, int, int, int]]:
    """Branches that differ: paragraphs i to j of the first became k to l of the second; none if roots are equal."""
    a, b = (read(x) if isinstance(x, str) else x for x in (a, b))
    branches: list[tuple[int, int, int, int]] = []
    if a.root != b.root:
        compared(a.sections, b.sections, branches=branches)
    return branches


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([t.text() for k in range(0, len(s), DOCS_AT_ONCE) for t in trees(list(s[k : k + DOCS_AT_ONCE]))], dtype=object)

    return df.withColumn(into, of(F.col(text)))


def order() -> list[Column]:
    """How documents follow each other."""
    return [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("lot")]


def in_order(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text, hash, lot) in partitions that are ranges of descending ids, null last, then of text hashes, then of the lot."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("lot"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS), 1)
    return rows.repartitionByRange(parts, *order()).sortWithinPartitions(*order())


def compare_with_edit(df: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document by descending id."""
    kind = df.schema["doc_id"].dataType
    result = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double".format(kind.simpleString())
    edge = f"{result}, edge string, task int, hash string, lot long, text string"
    form, pairs_form = to_arrow_schema(DataType.fromDDL(edge)), to_arrow_schema(DataType.fromDDL(result))

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def with_next(rows: list[tuple]) -> list[tuple]:
        """The result of each row (doc_id, text, next text)."""
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + r[2][: len(t) // 2] for t, r in zip(texts, rows, strict=True)]
        follow = [k + 1 if k + 1 < len(rows) and r[2] is texts[k + 1] else -1 for k, r in enumerate(rows)]
        own, new = trees(texts), trees(edited)
        after = iter(trees([r[2] for r, k in zip(rows, follow, strict=True) if k < 0]))
        out = []
        for r, t, e, x, k in zip(rows, own, new, edited, follow, strict=True):
            sha = hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()
            out.append((r[0], len(r[1]), sha, t.text(), e.text(), likeness(t, e), likeness(t, own[k] if k >= 0 else next(after))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all rows but the task's last, and the task's first and last row."""
        task, last = TaskContext.get().partitionId(), None
        at_edge = lambda r, name: (r[0], *[None] * 6, name, task, r[2], r[3], r[1])
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            if not rows:
                continue
            if last is None:
                yield batch([at_edge(rows[0], "first")], form)
            else:
                rows.insert(0, last)
            last = rows[-1]
            for k in range(0, len(rows) - 1, DOCS_AT_ONCE):
                some = rows[k : k + DOCS_AT_ONCE + 1]
                yield batch([(*r, *[None] * 5) for r in with_next([(r[0], r[1], after[1]) for r, after in pairwise(some)])], form)
        if last is not None:
            yield batch([at_edge(last, "last")], form)

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(with_next(list(zip(*(c.to_pylist() for c in b.columns), strict=True))), pairs_form)

    names = pairs_form.names
    found = in_order(df).mapInArrow(run, edge)
    both = F.concat("fingerprint", F.lit(" "), "edited_fingerprint").alias("both")  # in one value, so that zstd finds what they share
    found = cut(found.select(*(c for c in found.columns if not c.endswith("fingerprint")), both), "zstd")
    found = found.withColumns({"fingerprint": F.split_part("both", F.lit(" "), F.lit(1)), "edited_fingerprint": F.split_part("both", F.lit(" "), F.lit(2))})
    first, last = (found.where(F.col("edge") == name).select("task", "doc_id", "hash", "lot", "text") for name in ("first", "last"))
    by = Window.orderBy(*order())  # a row for each task, without its text
    follows = first.select("task", F.coalesce(F.lead("task").over(by), F.first("task").over(by)).alias("after"))
    pairs = last.select("task", "doc_id", "text").join(follows, "task").join(first.select(F.col("task").alias("after"), F.col("text").alias("next")), "after")
    ends = pairs.select("doc_id", "text", "next").mapInArrow(run_pairs, result)
    return found.where("edge IS NULL").select(*names).unionByName(ends)
