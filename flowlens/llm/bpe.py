"""BPE encoding and decoding with forced boundaries.

A text is split by the byte-level pattern. Inside a piece, two neighbouring bytes that occur side by side in no token of
the vocabulary can't be merged in any order of merges, so a cut between them is certain. The fragments between cuts are
encoded on their own and their ids put one after another.

All distinct fragments of some hundred documents are merged together as arrays: every round applies to each fragment its
best-ranked pair, at all its places. A merge's result is used only by later merges, so this equals one merge at a time.

Nulls count as empty texts, which have no ids. Every row gives one row, repeated rows too; columns other than those
named don't matter. Texts of any length are taken whole. Invalid byte sequences decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of these characters only, for the faster of two regular expression libraries.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r -~{LATIN}]*")
PLAIN_PATTERN = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
NEVER = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: visible Latin-1 stands for itself, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Number of each piece in order of first asking; new: pieces since the last encoding."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class ForcedBoundaryBpe:
    """A byte-level vocabulary with merges, read from the JSON text of a tokenizer file; another kind of file is an error."""

    def __init__(self, source: str, kept_pieces: int = 300_000):
        spec = json.loads(source)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("dropout"):
            raise ValueError("not a byte-level vocabulary that this splits as its file says")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = token
        self.first = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        raw = [tuple(bytes(letters[c] for c in x) for x in p) for p in pairs]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in raw], np.int64)
        self._table(key, np.array([vocab[a + b] for a, b in raw], np.int64))
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.kept_pieces = kept_pieces
        self._forget()

    def _table(self, key: np.ndarray, result: np.ndarray) -> None:
        """Open addressing: slots of pair, rank and result."""
        self.bits = max(4, int(len(key)).bit_length() + 2)
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NEVER, np.int64)
        self.slot_result = np.zeros(1 << self.bits, np.int64)
        left, place, self.probes = np.arange(len(key)), self._place(key), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[place] < 0
            some, one = np.unique(place[free], return_index=True)
            put = left[np.flatnonzero(free)[one]]
            self.slot_key[some], self.slot_rank[some], self.slot_result[some] = key[put], put, result[put]
            stay = ~np.isin(left, put)
            left, place = left[stay], (place[stay] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = self._place(key)
        slot = self.slot_key[at]
        todo = np.flatnonzero((slot != key) & (slot >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = self.slot_key[at[todo]]
            todo = todo[(slot[todo] != key[todo]) & (slot[todo] >= 0)]
        return np.where(slot == key, self.slot_rank[at], NEVER), self.slot_result[at]

    def _forget(self) -> None:
        self.index = Pieces()
        self.flat, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and keep their ids."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        opens = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        cut = np.zeros(len(buf), bool)
        cut[1:] = ~self.joined[buf[:-1], buf[1:]]
        cut[opens[:-1]] = True
        ids, where = self._merge(self.first[buf], np.cumsum(cut) - 1)
        piece = np.searchsorted(opens, np.flatnonzero(cut), "right") - 1
        counts = np.bincount(piece[where], minlength=len(raw))
        self.flat = np.concatenate([self.flat, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])

    def _merge(self, ids: np.ndarray, frag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within fragments (ascending numbers); the final ids and their fragments."""
        done_ids, done_frag = [], []
        while len(ids):
            rank, result = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
            same = np.flatnonzero(frag[:-1] == frag[1:])
            rank[same], result[same] = self._find(ids[same], ids[same + 1])
            opens = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
            sizes = np.diff(np.append(opens, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, opens), sizes)
            over = best == NEVER
            done_ids.append(ids[over])
            done_frag.append(frag[over])
            hit = (rank == best) & ~over
            if (hit[1:] & hit[:-1]).any():  # of overlapping places every other one, from the left
                run_open = hit & ~np.concatenate([[False], hit[:-1]])
                run_open |= np.concatenate([[True], frag[1:] != frag[:-1]])
                begun = np.maximum.accumulate(np.where(run_open, np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - begun) % 2 == 0
            ids = np.where(hit, result, ids)
            keep = ~np.concatenate([[False], hit[:-1]]) & ~over
            ids, frag = ids[keep], frag[keep]
        ids, frag = np.concatenate(done_ids or [ids]), np.concatenate(done_frag or [frag])
        order = np.argsort(frag, kind="stable")
        return ids[order], frag[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (uint32); names of special tokens in a text are those tokens."""
        if len(self.index) > self.kept_pieces:
            self._forget()
        number, rows = self.index.__getitem__, []
        for text in texts:
            parts = self.split.split(text or "") if self.split else [text or ""]
            row: list[int] = []
            for k, part in enumerate(parts):
                if k % 2:
                    row.append(-1 - self.special[part])
                    continue
                row.extend(map(number, (PLAIN_PATTERN if PLAIN.fullmatch(part) else self.pattern).findall(part)))
            rows.append(np.array(row, np.int64))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        return [self._gather(row) for row in rows]

    def _gather(self, row: np.ndarray) -> np.ndarray:
        marks = row < 0
        some = np.where(marks, 0, row)
        n = np.where(marks, 1, (self.bounds[some + 1] - self.bounds[some]) if len(self.bounds) > 1 else 1)
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(np.where(marks, 0, self.bounds[some]), n)
        out = self.flat[at] if len(self.flat) else np.zeros(len(at), np.int64)
        if marks.any():
            out[(ends - n)[marks]] = -1 - row[marks]
        return out.astype("<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file on the driver: one vocabulary, a few megabytes however much is encoded."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[int, ForcedBoundaryBpe] = {}


def _bpe(source: str) -> ForcedBoundaryBpe:
    """One per Python worker."""
    if (k := hash(source)) not in _loaded:
        _loaded.clear()
        _loaded[k] = ForcedBoundaryBpe(source)
    return _loaded[k]


DOCS_AT_ONCE = 500


def encode(df: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of its texts, an array of int; tokenizer is the text of a tokenizer file."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(shared.value)
        for s in batches:
            yield pd.Series([x.astype(np.int32) for k in range(0, len(s), DOCS_AT_ONCE) for x in bpe.encode(list(s[k : k + DOCS_AT_ONCE]))], dtype=object)

    return df.withColumn(into, ids(F.col(text)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the texts of arrays of ids; null gives an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(shared.value)
        for s in batches:
            yield pd.Series([bpe.decode([] if x is None else x) for x in s], dtype=object)

    return df.withColumn(into, text(F.col(ids)))


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass, and return digests: key, n_tokens, ids_sha256, decoded_sha256."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(shared.value)
        for b in batches:
            rows = []
            for k in range(0, len(b), DOCS_AT_ONCE):
                for ids in bpe.encode(list(b["text"][k : k + DOCS_AT_ONCE])):
                    back = bpe.decode(ids.tolist()).encode("utf-8", "replace")
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "key", b["key"].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    done = slim.mapInPandas(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("key", key)
