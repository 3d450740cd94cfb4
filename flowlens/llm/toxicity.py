"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are of documents, so token labels come first: words and word beginnings that stand in far more toxic than clean
labelled documents mark the tokens of toxic documents; all other tokens are clean. On windows around marked tokens and on
clean windows the field learns weights of hashed features (the word, its beginnings, its shape) and of transitions, by
gradient of the log likelihood, with forward-backward over all windows at once. A document is tagged sentence by
sentence; the marginals of its tokens aggregate to its score by a small logistic model of labelled documents, and tokens
of at least one half join to spans with offsets in code points.

Learning takes at most `most_labelled` labelled documents of each label, by hash, each text once (toxic if any label of it says
so), and of each of these at most `most_windows` windows with marked tokens and one without, by hash; tagging covers every row
and every token. Null texts count as empty; a text without words has the score of no evidence. Every row gives one row;
other columns don't matter. With no labelled toxic or no labelled clean document every score is the share of toxic
labels, 0 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut
from flowlens.llm._text import Words, hash_runs, mix, words
from flowlens.llm.quality import in_fold, labelled

HASH_BITS = 18
STARTS = (4, 5, 6, 7)  #: bytes of word beginnings
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE = 3, 6.0, 20.0
REACH, WINDOW = 8, 33

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True


class Tokens(NamedTuple):
    words: Words
    first: np.ndarray  #: bytes of each word without marks around it
    last: np.ndarray
    units: np.ndarray  #: hash of the word and of its beginnings, a column each; 0: the word is shorter
    slots: np.ndarray  #: weights of each word
    opens: np.ndarray  #: whether a sentence begins


def tokens(texts: list[str | None]) -> Iterator[Tokens]:
    for w in words(texts):
        n = len(w.start)
        letters = np.flatnonzero(_LETTER[w.buf])
        if not n or not len(letters):
            first, last = w.start, w.end
        else:
            a = letters[np.minimum(np.searchsorted(letters, w.start), len(letters) - 1)]
            b = letters[np.maximum(np.searchsorted(letters, w.end) - 1, 0)] + 1
            some = (a >= w.start) & (a < w.end)
            first, last = np.where(some, a, w.start), np.where(some, b, w.end)
        low = _LOWER[w.buf]
        units = np.zeros((n, 1 + len(STARTS)), np.uint64)
        units[:, 0] = hash_runs(low, first, last)
        for j, k in enumerate(STARTS, 1):
            units[:, j] = np.where(last - first > k, hash_runs(low, first, np.minimum(first + k, last)) + np.uint64(k), np.uint64(0))
        upper = (w.buf != low).astype(np.int64)
        shape = 1 + np.minimum(np.add.reduceat(np.append(upper, 0), np.stack([first, last], 1).ravel())[::2] if n else np.zeros(0, np.int64), 2)
        slots = np.column_stack([(units & np.uint64((1 << HASH_BITS) - 1)).astype(np.int32), shape.astype(np.int32)])
        slots[:, :-1] = np.where(units > 0, np.maximum(slots[:, :-1], 4), 0)
        doc = w.doc()
        opens = np.ones(n, bool)
        if n > 1:
            breaks = np.concatenate([[0], np.cumsum(w.buf == 0x0A)])
            ended = np.isin(w.buf[w.end - 1], list(b".?!"))
            opens[1:] = ended[:-1] | (doc[1:] != doc[:-1]) | (breaks[w.start[1:]] != breaks[w.end[:-1]])
        yield Tokens(w, first, last, units, slots, opens)


class Field(NamedTuple):
    """Weights of slots, of transitions clean-toxic, toxic-clean, toxic-toxic, and of the document's evidence."""

    weights: np.ndarray
    moves: np.ndarray
    document: np.ndarray

    def marginals(self, slots: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Chance of each token to be toxic; sentences begin where opens says."""
        n = len(slots)
        if not n:
            return np.zeros(0)
        e = np.exp(np.clip(self.weights[slots].sum(1), -30, 30))
        ot, to, tt = np.exp(self.moves)
        begin = np.flatnonzero(opens)
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        left = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # sentences with more than t tokens
        ahead, back = np.empty(n), np.ones(n)
        ahead[begin] = e[begin] * ot
        for t in range(1, int(size[0])):
            at = begin[: left[t]] + t
            r = ahead[at - 1]
            ahead[at] = np.clip(e[at] * (ot + r * tt) / (1 + r * to), 1e-30, 1e30)
        for t in range(int(size[0]) - 2, -1, -1):
            at = begin[: left[t + 1]] + t
            x = e[at + 1] * back[at + 1]
            back[at] = (to + tt * x) / (1 + ot * x)
        odds = ahead * back
        return odds / (1 + odds)


def evidence(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each document from its tokens' marginals: 1, log odds that any token is toxic, expected toxic tokens, their density."""
    some = np.where(p >= 0.05, p, 0.0)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
    none = sums(np.log1p(-np.minimum(some, 1 - 1e-9)))
    any_toxic = np.clip(np.log(np.maximum(-np.expm1(none), 1e-4)) - none, -9, 9)
    expected = sums(some)
    return np.column_stack([np.ones(len(at) - 1), any_toxic / 9, np.log1p(expected), np.log1p(100 * expected / np.maximum(np.diff(at), 1))])


def fit_field(slots: np.ndarray, y: np.ndarray, size: np.ndarray, rounds: int = 60, decay: float = 1e-5) -> Field:
    """Weights that maximise the log likelihood of windows: rows of tokens, padded; size: tokens of each."""
    n, length = y.shape
    live = np.arange(length)[None, :] < size[:, None]
    weights, moves = np.zeros(1 << HASH_BITS), np.array([-2.0, 0.0, 0.0])
    y = np.where(live, y, 0).astype(float)
    pairs = live[:, 1:]
    before, after = y[:, :-1], y[:, 1:]
    seen = np.array([(y[:, 0]).sum() + ((1 - before) * after * pairs).sum(), (before * (1 - after) * pairs).sum(), (before * after * pairs).sum()])
    state = [[np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)], [np.zeros(3), np.zeros(3)]]
    flat = slots[live].ravel()
    for step in range(1, rounds + 1):
        e = np.exp(np.clip(weights[slots].sum(2), -20, 20))
        ot, to, tt = np.exp(moves)
        alpha = np.zeros((length, n, 2))
        alpha[0] = np.column_stack([np.ones(n), e[:, 0] * ot])
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, length):
            o, x = alpha[t - 1, :, 0], alpha[t - 1, :, 1]
            a = np.column_stack([o + x * to, e[:, t] * (o * ot + x * tt)])
            alpha[t] = np.where(live[:, t, None], a / a.sum(1, keepdims=True), alpha[t - 1])
        beta = np.ones((n, 2))
        p = np.zeros((n, length))
        expected = np.zeros(3)
        for t in range(length - 1, -1, -1):
            g = alpha[t] * beta
            p[:, t] = np.where(live[:, t], g[:, 1] / g.sum(1), 0)
            if not t:
                break
            o, x = alpha[t - 1, :, 0], alpha[t - 1, :, 1]
            joint = np.column_stack([o * beta[:, 0], o * ot * e[:, t] * beta[:, 1], x * to * beta[:, 0], x * tt * e[:, t] * beta[:, 1]])
            joint /= joint.sum(1, keepdims=True)
            expected += (joint * live[:, t, None])[:, 1:].sum(0)
            new = np.column_stack([beta[:, 0] + ot * e[:, t] * beta[:, 1], to * beta[:, 0] + tt * e[:, t] * beta[:, 1]])
            new /= new.sum(1, keepdims=True)
            beta = np.where(live[:, t, None], new, beta)
        expected[0] += p[:, 0].sum()
        pull = np.bincount(flat, np.repeat((y - p)[live], slots.shape[2]), 1 << HASH_BITS)
        pull[0] = 0
        for k, (value, g) in enumerate(((weights, pull / n - decay * weights), (moves, (seen - expected) / n))):
            m, s = state[k]
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            value += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-6)
    weights[0] = 0
    return Field(weights, moves, np.zeros(4))


def fit_document(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic weights of evidence(); weight: how many labelled rows a row stands for."""
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton, with a little decay
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def telling_units(sample: DataFrame) -> np.ndarray:
    """Hashes of words and beginnings that tell toxic from clean documents of the labelled sample."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic = b["good"].to_numpy() == 1
            for t in tokens(list(b["text"])):
                doc = np.repeat(t.words.doc(), t.units.shape[1])
                own = t.units.ravel()
                _, one = np.unique(own ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
                own, kind = own[one], toxic[t.words.first + doc[one]]
                unit, where = np.unique(own[own > 0], return_inverse=True)
                bad = np.bincount(where, kind[own > 0], len(unit)).astype(np.int64)
                yield pd.DataFrame({"unit": unit.view(np.int64), "toxic": bad, "clean": np.bincount(where, minlength=len(unit)) - bad})

    sizes = {r["good"]: r["n"] for r in sample.groupBy("good").agg(F.count("*").alias("n")).collect()}
    n, m = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n or not m:
        return np.zeros(0, np.uint64)
    units = sample.mapInPandas(counted, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = (a + 0.5) / (n + 1) / ((b + 0.5) / (m + 1))
    gain = 2 * (a * F.log(a / ((a + b) * (n / (n + m)))) + F.when(b > 0, b * F.log(b / ((a + b) * (m / (n + m))))).otherwise(0.0))
    told = units.where((a >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (gain >= LEAST_EVIDENCE)).select("unit").toPandas()  # of a bounded sample
    return np.sort(told["unit"].to_numpy(np.int64).view(np.uint64))


def least_of_each(group: np.ndarray, rank: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Of each group (sorted) the `most` values of the least rank."""
    order = np.lexsort((rank, group))
    first = np.searchsorted(group, group[order])
    return value[order][np.arange(len(order)) - first < most]


def train(sample: DataFrame, most_windows: int = 2) -> Field:
    """Learn from the bounded sample of quality.labelled(label='toxic'), by most_windows windows with marked tokens of a text and one without."""
    told_by = F.max(F.struct("good", "key", "n"))
    sample = cut(sample.groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(told_by.alias("t"), F.first("text").alias("text")).select("t.*", "text"))
    told = telling_units(sample)
    shared = sample.sparkSession.sparkContext.broadcast(told)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic = b["good"].to_numpy() == 1
            for t in tokens(list(b["text"])):
                doc, n = t.words.doc(), len(t.units)
                marked = np.isin(t.units, shared.value).any(1) & toxic[t.words.first + doc] if n else np.zeros(0, bool)
                centre = np.flatnonzero(marked)
                if len(centre):  # one window for marked tokens close to each other
                    centre = centre[np.concatenate([[True], np.diff(centre) > REACH])]
                plain = np.flatnonzero(~marked)
                some = np.concatenate([least_of_each(doc[at], mix(t.words.key[at] + (at - t.words.at[doc[at]]).astype(np.uint64)), at, k) for at, k in ((centre, most_windows), (plain, 1))])
                low, high = np.maximum(some - WINDOW // 2, t.words.at[doc[some]]), np.minimum(some + WINDOW // 2 + 1, t.words.at[doc[some] + 1])
                pairs = list(zip(low.tolist(), high.tolist(), strict=True))
                if pairs:
                    yield pd.DataFrame({"slots": [t.slots[i:j].tobytes() for i, j in pairs], "y": [marked[i:j].astype(np.int8).tobytes() for i, j in pairs]})

    rows = sample.mapInPandas(windows, "slots binary, y binary").toPandas()
    if not len(told) or not len(rows):
        return Field(np.zeros(1 << HASH_BITS), np.full(3, -5.0), np.zeros(4))
    rows = rows.sort_values(["slots", "y"], ignore_index=True)
    size = rows["y"].map(len).to_numpy()
    y, slots = np.zeros((len(rows), WINDOW), np.int8), np.zeros((len(rows), WINDOW, 2 + len(STARTS)), np.int32)
    for i, (s, v) in enumerate(zip(rows["slots"], rows["y"], strict=True)):
        y[i, : len(v)], slots[i, : len(v)] = np.frombuffer(v, np.int8), np.frombuffer(s, np.int32).reshape(len(v), -1)
    field = fit_field(slots, y, size)
    carried = sample.sparkSession.sparkContext.broadcast(field)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack([np.zeros((0, 4)), *(evidence(carried.value.marginals(t.slots, t.opens), t.words.at) for t in tokens(list(b["text"])))])
            yield b[["key", "good", "n"]].assign(x=list(x))

    kind = sample.schema["key"].dataType.simpleString()
    docs = sample.mapInPandas(measured, f"key {kind}, good int, n long, x array<double>").toPandas().sort_values(["key", "good"], kind="stable")
    toxic = docs["good"].to_numpy() == 1
    weight = docs["n"].to_numpy(float) / np.where(toxic, toxic.sum(), (~toxic).sum())
    return field._replace(document=fit_document(np.array(docs["x"].tolist()), toxic, weight))


def tag(df: DataFrame, field: Field, prior: float | None = None, key: str = "doc_id") -> DataFrame:
    """key, score, toxic_tokens (expected) and spans (begin, end in code points) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            score, count, spans = np.zeros(len(b)), np.zeros(len(b)), [[] for _ in range(len(b))]
            for t in tokens(list(b["text"])):
                w, p = t.words, f.marginals(t.slots, t.opens)
                x = evidence(p, w.at)
                score[w.first : w.first + w.n] = 1 / (1 + np.exp(-np.clip(x @ f.document, -30, 30))) if prior is None else prior
                count[w.first : w.first + w.n] = np.expm1(x[:, 2])
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
                    doc = w.doc()[hit]
                    split = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(doc) > 0) | t.opens[hit[1:]]]))
                    for i, j in zip(split, np.append(split[1:], len(hit)), strict=True):
                        base = chars[w.begin[doc[i]]]
                        spans[w.first + doc[i]].append({"begin": int(chars[t.first[hit[i]]] - base), "end": int(chars[t.last[hit[j - 1]]] - base)})
            yield pd.DataFrame({"key": b["key"], "score": score, "toxic_tokens": count, "spans": spans})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), "text").mapInPandas(run, f"key {kind}, score double, toxic_tokens double, spans array<struct<begin:int,end:int>>")
    return out.withColumnRenamed("key", key)


def classify(df: DataFrame, labels: DataFrame, most_labelled: int = 4000, parts: int = 5, held: int = 0, key: str = "doc_id") -> DataFrame:
    """key, score, predicted, toxic_tokens, spans; labels of the held-out fold are never learnt."""
    known = labels.where(~in_fold(key, parts, held))
    sample = labelled(df, known, most_labelled, label="toxic", key=key)
    field = train(sample)
    prior = None
    if not field.weights.any():
        shares = {r["toxic"]: r["n"] for r in known.where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    return tag(df, field, prior, key).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
