"""Components over links of 80 percent against all pairs of sets."""

import random

import numpy as np
import pytest

from flowlens.llm import setsketch
from flowlens.llm.jaccard import shingles

from .brute import words
from .conftest import ROWS, prose


def plain(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = words((text or "").translate(fold))
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w))
    kinds = sorted(set(sets) - {frozenset()}, key=len)
    group = {s: s for s in kinds}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for n, a in enumerate(kinds):
        for b in kinds[n + 1 :]:
            if 100 * len(a) >= 80 * len(b) and 100 * len(a & b) >= 80 * len(a | b):
                group[root(a)] = root(b)
    low = {}
    for (key, _), s in zip(rows, sets, strict=True):
        if s and key is not None:
            low[root(s)] = min(low.get(root(s), key), key)
    told = [(key, len(s), low.get(root(s)) if s else key) for (key, _), s in zip(rows, sets, strict=True)]
    return sorted(map(repr, ((key, n, c, key == c) for key, n, c in told)))


def run(spark, df):
    return sorted(map(repr, map(tuple, setsketch.components(df).collect())))


def test_rows_of_every_kind(docs, nothing, spark):
    assert run(spark, docs) == plain([r[:2] for r in ROWS])
    assert setsketch.components(nothing).count() == 0


def test_ids_of_text(spark):
    rows = [("b", "one two three"), ("a", "ONE two three"), ("c", None), (None, "one two three")]
    assert run(spark, spark.createDataFrame(rows, "doc_id string, text string")) == plain(rows)


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(x + "z" + str(r.randrange(99)) if r.random() < share else x for x in text.split(" "))


@pytest.mark.parametrize("share", [0.02, 0.055, 0.1])
def test_large_groups_of_near_copies(spark, monkeypatch, share):
    """A group far above a block: its copies link with the first text, and with each other about as often as not."""
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    base = prose(150, 77)
    rows = [(i, edited(base, share, i) if i else base) for i in range(300)]
    rows += [(1000 + i, prose(40 + i % 60, 500 + i)) for i in range(200)] + [(2000 + i, edited(prose(40 + i % 60, 500 + i), 0.03, i)) for i in range(0, 200, 3)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(spark, df) == plain(rows)


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.8, 1.0])
def test_registers_agree_and_tell_the_similarity(similarity):
    r = np.random.default_rng(4)
    n, agreed, told = 600, [], []
    for _ in range(30):
        both = round(2 * n * similarity / (1 + similarity))
        key = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = key[:n], key[len(key) - n :]
        x, y = setsketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        joined = setsketch.sketches(np.unique(key), np.array([0, len(key)]))[0]
        assert (np.maximum(x, y) == joined).all()
        agreed.append((x == y).mean())
        told.append(setsketch.likely(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), float(n), float(n))), 0.8)[0])
    least = np.log(1 + similarity * (setsketch.BASE - 1)) / np.log(setsketch.BASE)
    assert least - 0.02 <= np.mean(agreed) <= least + 0.06
    assert all(told) if similarity >= 0.8 else not any(told)


def test_sizes_that_cannot_reach_the_threshold_go():
    one = np.array([0])
    assert not setsketch.likely(one, one, np.array([79.0]), np.array([100.0]), 0.8)[0]
    assert next(shingles(["a b a b"], 2))[2].size == 2
