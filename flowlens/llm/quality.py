"""Quality classifier: Bradley-Terry ranking of documents.

A preference pair is a labelled good document and a labelled bad one. Each document has a strength, linear in features of
its whole text, and the good one is preferred with probability sigmoid(strength difference). The weights minimise this
logistic loss on feature differences. A quantile of the labelled documents' strengths, the share of bad labels by
default, becomes the threshold; strengths are mapped to scores between 0 and 1 so that this quantile gets score 0.7.

Features are shares and lengths of a text, in bins, so that either extreme can be bad; they use nothing but the text.
Fitting takes at most `most_labelled` labelled documents of each label, those with the lowest hashes; scoring covers every row.

Null texts count as empty; an empty text gets the score of its features like any other. Every row gives one row. Labels that
are null, other than 0 and 1, or without a document are left out; a document of several texts is learnt by the one with the
least hash. With no pair to learn from (an empty table, one label only) every score is 0.5. A column of the caller named as an
output gives way to it, so name outputs otherwise (`into`) to keep it; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._text import inside, mix, windows, words

THRESHOLD = 0.7
BINS = 12

_KIND = np.zeros(256, np.int64)  #: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space, 7 beyond ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[list(b".,;:'\"()-")] = 4
_KIND[list(b"#*$%&|<>@^~_=+{}[]\\/")] = 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
_KIND[0x80:] = 7

NAMES = ["lower", "upper", "digit", "mark", "symbol", "beyond", "exclaim", "words", "word_length", "word_spread", "distinct", "repeated", "lines", "same_lines", "sentence_words", "capital_words", "unmarked_ends"]


def first_of_doc(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Running number, by document, of different keys in documents 0 to n - 1; one more entry at the start."""
    own = key ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    first = np.ones(len(own), bool)
    first[1:] = own[order][1:] != own[order][:-1]
    return np.concatenate([[0], np.cumsum(np.bincount(doc[order[first]], minlength=n))])


def features(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES for each text."""
    out = [np.zeros((0, len(NAMES)))]
    for w in words(texts):
        n, doc = w.n, w.doc()
        byte_doc = np.repeat(np.arange(n), np.diff(w.begin))
        kinds = np.bincount(byte_doc * 8 + _KIND[w.buf], minlength=8 * n).reshape(n, 8)
        solid = np.maximum(kinds.sum(1) - kinds[:, 6], 1)
        count = np.diff(w.at)
        many = np.maximum(count, 1)
        per = lambda x: np.bincount(doc, x, n)
        length = (w.end - w.start).astype(float)
        mean = per(length) / many
        spread = np.sqrt(np.maximum(per(length**2) / many - mean**2, 0))
        different = np.diff(first_of_doc(w.key, doc, n))
        grams, within = windows(w.key, 3), inside(w, 3)
        gram_count = np.maximum(count - 2, 0)
        again = gram_count - np.diff(first_of_doc(grams[within], doc[: len(grams)][within], n))
        last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        head = w.buf[w.start] if len(w.start) else np.zeros(0, np.uint8)
        stop = np.isin(last, list(b".?!"))
        rows = [[t for t in (x or "").split("\n") if t] for x in texts[w.first : w.first + n]]
        lines = np.array([len(r) for r in rows], float)
        same = np.array([len(r) - len(set(r)) for r in rows], float)
        ends = np.array([sum(r_[-1] not in ".?!:;" for r_ in r) for r in rows], float)
        out.append(np.column_stack([
            kinds[:, 1] / solid, kinds[:, 2] / solid, kinds[:, 3] / solid, kinds[:, 4] / solid, kinds[:, 5] / solid, kinds[:, 7] / solid,
            np.bincount(byte_doc[w.buf == 0x21], minlength=n) / solid,
            np.log1p(count), mean, spread, different / many, again / many,
            np.log1p(lines), same / np.maximum(lines, 1), count / (1 + per(stop * 1.0)), per((_KIND[head] == 2) * 1.0) / many, ends / np.maximum(lines, 1),
        ]))
    return np.vstack(out)


class Ranking(NamedTuple):
    """Bin edges and weight of each bin of each feature; strength at the threshold; steepness of the score."""

    edges: np.ndarray
    weights: np.ndarray
    middle: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j, (e, v) in enumerate(zip(self.edges, self.weights, strict=True)):
            total += v[np.searchsorted(e, x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.middle) + shift, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, bad_share: float, pairs: int = 30_000, rounds: int = 300, decay: float = 1e-3, seed: int = 3) -> Ranking:
    """Rank rows of x so that good ones win; bad_share: share of bad labels, the quantile that becomes the threshold."""
    empty = Ranking(np.zeros((x.shape[1], BINS - 1)), np.zeros((x.shape[1], BINS)), 0.0, 0.0)
    if not good.any() or good.all():
        return empty
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    balance = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    edges = np.zeros((x.shape[1], BINS - 1))
    for j in range(x.shape[1]):  # quantiles with either label weighing half
        order = np.argsort(x[:, j], kind="stable")
        edges[j] = x[order, j][np.minimum(np.searchsorted(np.cumsum(balance[order]), inner), len(x) - 1)]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "right") + j * BINS for j, e in enumerate(edges)])
    size = x.shape[1] * BINS
    rng = np.random.default_rng(seed)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    n = max(pairs, len(win), len(lose))  # every labelled row is in some pair
    a = rng.permutation(np.resize(win, n))
    b = rng.permutation(np.resize(lose, n))
    weights, grad, square = np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        s = weights[bins].sum(1)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))  # chance of the wrong order
        pull = np.bincount(a, p, len(x)) - np.bincount(b, p, len(x))
        g = -np.bincount(bins.ravel(), np.repeat(pull, bins.shape[1]), size) / n + decay * weights
        grad, square = 0.9 * grad + 0.1 * g, 0.99 * square + 0.01 * g * g
        weights = weights - 0.1 * (grad / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    s = weights[bins].sum(1)
    share = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(share[order]), bad_share))
    low, high = s[order[min(at, len(s) - 1)]], s[order[min(at + 1, len(s) - 1)]]
    return Ranking(edges, weights.reshape(-1, BINS), float((low + high) / 2), 1.0)


def labelled(df: DataFrame, labels: DataFrame, most_labelled: int, label: str = "quality", key: str = "doc_id") -> DataFrame:
    """Texts with labels (key, text, good, n): at most most_labelled documents of each label, by hash; n: how many have this label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("good")).distinct()
    known = known.join(df.select(F.col(key).alias("key")), "key", "left_semi")
    counts = known.groupBy("good").agg(F.count("*").alias("n"))
    hashed = known.withColumn("h", F.xxhash64("key"))
    some = [hashed.where(F.col("good") == v).orderBy("h", "key").limit(most_labelled) for v in (0, 1)]
    some = some[0].unionByName(some[1]).join(F.broadcast(counts), "good")  # two rows
    texts = df.select(F.col(key).alias("key"), "text").join(F.broadcast(some), "key")  # 2 * most_labelled rows
    text = F.coalesce("text", F.lit(""))
    return texts.groupBy("key", "good", "n").agg(F.min_by(text, F.md5(text.cast("binary"))).alias("text"))


def train(sample: DataFrame) -> Ranking:
    """Fit on the bounded sample of labelled(); only features reach the driver."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["key", "good", "n"]].assign(x=list(features(list(b["text"]))))

    rows = sample.mapInPandas(measured, f"{sample.schema['key'].name} {sample.schema['key'].dataType.simpleString()}, good int, n long, x array<double>").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0, bool), 0.0)
    rows = rows.sort_values(["key", "good"], kind="stable")
    x, good = np.array(rows["x"].tolist()), rows["good"].to_numpy() == 1
    n = {g: float(v) for g, v in zip(rows["good"], rows["n"], strict=True)}
    return fit(x, good, n.get(0, 0.0) / max(sum(n.values()), 1.0))


def score(df: DataFrame, ranking: Ranking, text: str = "text", into: str = "score") -> DataFrame:
    """df with the score of each text."""
    shared = df.sparkSession.sparkContext.broadcast(ranking)  # some hundred numbers

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.score(features(list(s))))

    return df.withColumn(into, scores(F.col(text)))


def in_fold(key: str, parts: int, held: int) -> F.Column:
    """Whether crc32 of the key as text leaves this remainder; null: no."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, most_labelled: int = 6000, parts: int = 4, held: int = 2, key: str = "doc_id") -> Ranking:
    """The ranking of df's labelled texts; labels of the held-out fold are never learnt."""
    return train(labelled(df, labels.where(~in_fold(key, parts, held)), most_labelled, key=key))


def classify(df: DataFrame, labels: DataFrame, most_labelled: int = 6000, parts: int = 4, held: int = 2, key: str = "doc_id", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df with score and predicted, or what `into` calls them."""
    ranking = learn(df, labels, most_labelled, parts, held, key)
    return score(df, ranking, into=into[0]).withColumn(into[1], (F.col(into[0]) >= THRESHOLD).cast("int"))
