"""Substring dedup with compressed FM-indexes.

A window is `size` words in a row of one document; the words of every window whose sequence starts anywhere else too are
removed, wherever it stands. Windows are judged on the input.

Windows that could be equal are brought together first. A window's anchor is the smallest hash of its runs of GRAM words,
so equal windows have equal anchors, and an anchor that occurs once in all texts has no repeated window. Windows in a row
with one anchor are a unit of text. Units of an anchor go to the shard of the anchor; if more than `hot` places have
it, each window is a unit and goes to the shard of its own hash. Equal units are added up where they are made, so that a
shard gets each once from a task, however often it stands in the texts.

A shard keeps its units in an FM-index: the Burrows-Wheeler transform in a wavelet tree shaped by Huffman's codes, so that a word
takes about as many bits as its frequency says, in bit vectors with counts for each 64 bits. A unit that stands in the texts
more than once is in it twice. Units are streamed against it: backward search from a window's end takes in words as long as
what is matched occurs twice. Where it stops, no window that starts up to there can be repeated, so the search goes on behind.
The first and the last repeated window of a unit give its interval, for windows of a unit overlap. Intervals of all units
of a text are joined with it again by its hash, and their words removed.

Null texts have no words. Texts with equal words are judged together, so copies and repeated rows of `size` words or more
lose everything. Texts below that lose nothing. An empty table gives no rows; other columns don't matter. Words are told apart
by 32 bits of their hash within a window, texts and units by 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut
from flowlens.llm._text import Words, inside, mix, powers, windows, words

SIZE, GRAM, HOT = 35, 8, 2000
SHARD_WORDS = 4 << 20


def sequence_ids(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """63-bit hash of each run key[at[i]:at[i + 1]] of word hashes, not 0; 0 for an empty run."""
    n = np.diff(at)
    if not len(key):
        return np.zeros(len(n), np.int64)
    place = np.arange(len(key)) - np.repeat(at[:-1] - at[0], n)
    value = mix(key) * powers(int(n.max()) + 1)[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    h = mix(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]] + mix(n.astype(np.uint64)))
    return np.where(n > 0, (h >> np.uint64(1)).astype(np.int64) | 1, 0)


def anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit: document, anchor, first and last window (word places in the document)."""
    valid = inside(w, size)
    gram = windows(w.key, GRAM)
    best, reach = np.arange(len(gram)), 1
    most = size - GRAM + 1
    smaller = lambda a, b: np.where(gram[a] <= gram[b], a, b)
    while 2 * reach <= most:
        best = smaller(best[: len(best) - reach], best[reach:]) if len(best) > reach else best[:0]
        reach *= 2
    n = max(0, len(gram) - most + 1)
    best = smaller(best[:n], best[most - reach : most - reach + n])
    valid = valid[:n]
    start = np.flatnonzero(valid & np.concatenate([[True], (best[1:] != best[:-1]) | ~valid[:-1]])) if n else np.zeros(0, np.int64)
    stop = np.flatnonzero(valid & np.concatenate([(best[1:] != best[:-1]) | ~valid[1:], [True]])) if n else np.zeros(0, np.int64)
    doc = w.doc()[start]
    return doc, gram[best[start]], start - w.at[doc], stop - w.at[doc]


def bases(df: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), doc (hash of its words), n_words and digest of all words of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w in words(list(b["text"])):
                raw = w.buf.tobytes()
                digest = [hashlib.sha256(b" ".join(raw[i:j].split())).hexdigest() for i, j in zip(w.begin[:-1], w.begin[1:], strict=True)]
                own = b.iloc[w.first : w.first + w.n]
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "hash": own["hash"].to_numpy(), "doc": sequence_ids(w.key, w.at), "n_words": np.diff(w.at), "digest": digest})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), "text").mapInPandas(run, f"doc_id {kind}, hash string, doc long, n_words long, digest string")


def anchored(df: DataFrame, size: int) -> DataFrame:
    """anchor, doc, first and last of each unit of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w in words(list(b["text"])):
                doc, anchor, first, last = anchors(w, size)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "doc": sequence_ids(w.key, w.at)[doc], "first": first.astype(np.int32), "last": last.astype(np.int32)})

    return df.select("text").mapInPandas(run, "anchor long, doc long, first int, last int")


def units(b: pd.DataFrame, size: int, hot: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Units of texts with repeated anchors: rows of route, unit (hash), doc, at (its first word), copies; bounds of their words; words."""
    for w in words(list(b["text"])):
        ids, own = sequence_ids(w.key, w.at), b.iloc[w.first : w.first + w.n]
        n = np.where(ids == own["doc"].to_numpy(), own["first"].map(len).to_numpy(), 0)  # another text with the same doc_id has other words
        if not n.sum():
            continue
        flat = lambda name: np.concatenate([x for x, k in zip(own[name], n.tolist(), strict=True) if k])
        doc, anchor, places = np.repeat(np.arange(w.n), n), flat("anchor").astype(np.int64), flat("places")
        first, last = w.at[doc] + flat("first"), w.at[doc] + flat("last")
        many = np.where(places > hot, last - first + 1, 1)  # windows of their own
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc, begin, alone = np.repeat(doc, many), np.repeat(first, many) + step, np.repeat(places > hot, many)
        end = np.where(alone, begin, np.repeat(last, many)) + size
        route = np.repeat(anchor, many)
        if alone.any():
            route[alone] = windows(w.key, size)[begin[alone]].view(np.int64)
        length = end - begin
        at = np.concatenate([[0], np.cumsum(length)])
        key = w.key[np.arange(at[-1]) + np.repeat(begin - at[:-1], length)]
        rows = pd.DataFrame({"route": route, "unit": sequence_ids(key, at), "doc": ids[doc], "at": (begin - w.at[doc]).astype(np.int32), "copies": own["copies"].to_numpy()[doc]})
        yield rows, at, key.astype(np.uint32)


class Bits:
    """Bit vector with counts before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.word = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word))[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.word[block] & mask)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each letter in Huffman's code; 0: the letter doesn't occur. Two queues, of letters by count and of joined ones."""
    own = np.flatnonzero(counts)
    own = own[np.argsort(counts[own], kind="stable")]
    n, out = len(own), np.zeros(len(counts), np.int64)
    if n < 2:
        out[own] = 1
        return out
    weight, parent, leaf, joined = counts[own].tolist(), [0] * (2 * n - 1), 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (joined >= new or weight[leaf] <= weight[joined]):
                at, leaf = leaf, leaf + 1
            else:
                at, joined = joined, joined + 1
            total += weight[at]
            parent[at] = new
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    out[own] = depth[:n]
    return out


class WaveletTree:
    """How often a letter occurs before a place: a level of bits for each bit of the letters' codes, its nodes side by side."""

    def __init__(self, text: np.ndarray, letters: int):
        self.length = code_lengths(np.bincount(text, minlength=letters))
        self.code = np.zeros(letters, np.int64)
        order = np.lexsort((np.arange(letters), self.length))
        order, code, last = order[self.length[order] > 0], 0, 0
        for letter, n in zip(order.tolist(), self.length[order].tolist(), strict=True):  # canonical: shorter ones first
            code <<= n - last
            self.code[letter], last = code, n
            code += 1
        self.levels, self.start, self.ones_before = [], [], []
        for level in range(int(self.length.max(initial=0))):
            left = self.length[text] - level
            node, bits = self.code[text] >> left, (self.code[text] >> (left - 1)) & 1
            own = Bits(bits.astype(bool))
            alive = self.length > level
            start = np.zeros(letters, np.int64)
            start[alive] = np.searchsorted(node, self.code[alive] >> (self.length[alive] - level))
            self.levels.append(own)
            self.start.append(start)
            self.ones_before.append(own.ones(start))
            ones = np.cumsum(bits) - bits
            opens = np.concatenate([[True], node[1:] != node[:-1]])
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(text)), 0))
            ends = np.append(np.flatnonzero(opens)[1:], len(text))[np.cumsum(opens) - 1]
            one_rank = ones - ones[begin]
            zeros = (ends - begin) - (np.append(ones, ones[-1] + bits[-1])[ends] - ones[begin])
            place = begin + np.where(bits == 1, zeros + one_rank, np.arange(len(text)) - begin - one_rank)
            following = np.empty_like(text)
            following[place] = text
            text = following[self.length[following] > level + 1]

    def count(self, letter: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each letter occurs before place i."""
        length, code, out = self.length[letter], self.code[letter], i.copy()
        live = np.arange(len(letter))
        for level, (bits, start, before) in enumerate(zip(self.levels, self.start, self.ones_before, strict=True)):
            live = live[length[live] > level]
            if not len(live):
                break
            own, at = letter[live], out[live]
            ones = bits.ones(start[own] + at) - before[own]
            out[live] = np.where((code[live] >> (length[live] - 1 - level)) & 1, ones, at - ones)
        return out


class FmIndex:
    """Counts of word sequences of at most `depth` words in texts, by backward search."""

    def __init__(self, text: np.ndarray, depth: int):
        """text: numbers from 1, with 0 between texts and at the end."""
        letters = int(text.max(initial=0)) + 1
        last = text[self._sorted(text, depth) - 1]  # what stands before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))]).astype(np.int64)
        self.tree = WaveletTree(last, letters)
        self.size = len(text)

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first words, depth at least, by doubling."""
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (len(text) + 1)
            key[: len(text) - width] += rank[width:] + 1 if width < len(text) else 0
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(len(text), np.int64)
            rank[order] = fresh
            width *= 2
            if width >= depth + 1 or fresh[-1] == len(text) - 1:
                return order

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin with the letter and then with what those from low to high begin with."""
        both = self.tree.count(np.concatenate([letter, letter]), np.concatenate([low, high])) + np.tile(self.first[letter], 2)
        return both[: len(low)], both[len(low) :]


def repeated(index: FmIndex, text: np.ndarray, begin: np.ndarray, windows_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window of each unit (text[begin:]) of windows_of windows; -1: none."""
    low_window, high_window = np.full(len(begin), -1), np.full(len(begin), -1)
    for upward, found, who in ((True, low_window, np.arange(len(begin))), (False, high_window, None)):
        who = np.flatnonzero(low_window >= 0) if who is None else who
        at = np.zeros(len(who), np.int64) if upward else windows_of[who] - 1
        place = at + size  # behind the word to take in next, in the unit
        low, high = np.zeros(len(who), np.int64), np.full(len(who), index.size)
        while len(who):
            place -= 1
            low, high = index.extend(text[begin[who] + place], low, high)
            failed = high - low < 2
            done = ~failed & (place == at)
            found[who[done]] = at[done]
            at = np.where(failed, place + 1 if upward else at - 1, at)
            over = done | (failed & ((at >= windows_of[who]) | (at < 0)))
            if not upward:
                over |= failed & (at <= low_window[who])
                known = failed & (at == low_window[who])
                found[who[known]] = at[known]
            place = np.where(failed, at + size, place)
            low, high = np.where(failed, 0, low), np.where(failed, index.size, high)
            keep = ~over
            who, at, place, low, high = who[keep], at[keep], place[keep], low[keep], high[keep]
    return low_window, high_window


def judged(unit: np.ndarray, copies: np.ndarray, parts: list[np.ndarray], size: int) -> pd.DataFrame:
    """Of one shard's units: the first and last repeated window of those that have any."""
    _, one, where = np.unique(unit, return_index=True, return_inverse=True)
    total = np.bincount(where, copies).astype(np.int64)
    twice = np.minimum(total, 2)  # once more is enough to be found again
    parts = [parts[i] for i, k in zip(one.tolist(), twice.tolist(), strict=True) for _ in range(k)]
    n = np.array([len(p) for p in parts])
    text = np.zeros(n.sum() + len(n) + 1, np.int64)
    begin = 1 + np.cumsum(n + 1) - (n + 1)
    places = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
    text[places] = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
    own = np.cumsum(twice) - twice
    first, last = repeated(FmIndex(text, size), text, begin[own], n[own] - size + 1, size)
    hit = first >= 0
    return pd.DataFrame({"unit": unit[one][hit], "from": first[hit].astype(np.int32), "to": last[hit].astype(np.int32)})


def removals(df: DataFrame, base: DataFrame, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """doc, n_removed and kept (text) of texts that lose words."""
    places = cut(anchored(df, size))
    counts = cut(places.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1"))
    near = places.join(counts, "anchor").groupBy("doc").agg(F.collect_set(F.struct("first", "last", "anchor", "places")).alias("units"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    heads = base.where(F.col("n_words") >= size).groupBy("doc").agg(head.alias("head"), F.count("*").alias("copies"))
    wanted = cut(near.join(heads, "doc").select("doc", "units", "copies", F.col("head.doc_id").alias("head_id"), F.col("head.hash").alias("hash")))
    volume = F.sum(F.aggregate("units", F.lit(0).cast("long"), lambda n, u: n + u["last"] - u["first"] + size))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, (wanted.agg(volume).first()[0] or 0) // SHARD_WORDS)
    own = df.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("hash"))  # other texts can have the head's id, and its row can be repeated
    texts = own.join(wanted, (own["hash"] == wanted["hash"]) & F.col("doc_id").eqNullSafe(F.col("head_id"))).dropDuplicates(["doc"])
    found = cut(texts.select("doc", "text", "copies", *(F.col(f"units.{c}").alias(c) for c in ("first", "last", "anchor", "places"))))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, at, flat in units(b, size, hot):
                unit, one, where = np.unique(rows["unit"].to_numpy(), return_index=True, return_inverse=True)
                raw, at = flat.tobytes(), 4 * at
                yield pd.DataFrame({"route": rows["route"].to_numpy()[one], "unit": unit, "copies": np.bincount(where, rows["copies"]).astype(np.int64), "words": [raw[i:j] for i, j in zip(at[one].tolist(), at[one + 1].tolist(), strict=True)]})

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, copies, text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for b in batches:
            unit.append(b["unit"].to_numpy())
            copies.append(b["copies"].to_numpy())
            text.extend(np.frombuffer(x, np.uint32) for x in b["words"])
        if text:
            yield judged(np.concatenate(unit), np.concatenate(copies), text, size)

    def standing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, _, _ in units(b, size, hot):
                yield rows[["unit", "doc", "at"]].drop_duplicates()

    content = found.mapInPandas(contents, "route long, unit long, copies long, words binary").repartition(parts, "route")
    hits = cut(content.mapInPandas(shard, "unit long, from int, to int"))
    stands = found.mapInPandas(standing, "unit long, doc long, at int").join(hits, "unit")
    spans = stands.groupBy("doc").agg(F.collect_set(F.struct((F.col("at") + F.col("from")).alias("begin"), (F.col("at") + F.col("to") + size).alias("end"))).alias("spans"))

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, own in zip(b["doc"], b["text"], b["spans"], strict=True):
                parts_ = text.encode("utf-8", "replace").split()
                gone = np.zeros(len(parts_) + 1, np.int64)
                for s in own:
                    gone[s["begin"]] += 1
                    gone[s["end"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                rows.append((doc, int(gone.sum()), b" ".join(p for p, g in zip(parts_, gone.tolist(), strict=True) if not g).decode()))
            yield pd.DataFrame(rows, columns=["doc", "n_removed", "kept"])

    return found.select("doc", "text").join(spans, "doc").mapInPandas(removed, "doc long, n_removed long, kept string")


def remove_repeats(df: DataFrame, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    base = cut(bases(df))
    lost = removals(df, base, size, hot).select("doc", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept"))
    out = base.join(cut(lost), "doc", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "digest").alias("kept_sha256"))
