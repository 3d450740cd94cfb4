"""The two classifiers against held-out labels, and forward-backward against all taggings."""

import itertools
import os
import zlib

import numpy as np
import pytest

from flowlens.llm import quality, queries, toxicity

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def area(scores, labels):
    """Chance that a row of label 1 scores above one of label 0, ties half."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return float(((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean())


def judged(spark, query, label, parts, held):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{DIR}/labels.parquet").where(f"{label} in (0, 1)").collect()}
    rows = query(spark, DIR).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
    own = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.array([r["score"] for r in own]), np.array([labels[r["doc_id"]] for r in own]), np.array([r["predicted"] for r in own])


@tables
def test_quality_of_held_out_documents(spark):
    scores, labels, predicted = judged(spark, queries.op1_quality, "quality", 4, 2)
    assert len(labels) > 50 and area(scores, labels) > 0.97 and (predicted == (scores >= 0.7)).all() and (predicted == labels).mean() > 0.9


@tables
def test_toxicity_of_held_out_documents(spark):
    scores, labels, predicted = judged(spark, queries.op5_toxicity, "toxic", 5, 0)
    assert len(labels) > 40 and area(scores, labels) > 0.75 and (predicted == (scores >= 0.5)).all() and predicted[labels == 0].mean() < 0.05


def test_marginals_equal_sums_over_all_taggings():
    rng = np.random.default_rng(2)
    n = 9
    slots = rng.integers(4, 50, (n, 3)).astype(np.int32)
    opens = np.zeros(n, bool)
    opens[[0, 4]] = True
    weights = np.zeros(1 << toxicity.HASH_BITS)
    weights[:50] = rng.normal(size=50)
    field = toxicity.Field(weights, np.array([-0.7, 0.4, 1.1]), np.zeros(4))
    own, total = np.zeros(n), 0.0
    for tags in itertools.product((0, 1), repeat=n):
        worth = sum(weights[slots[i]].sum() for i in range(n) if tags[i])
        for i in range(n):
            before = 0 if opens[i] else tags[i - 1]
            worth += {(0, 0): 0.0, (0, 1): field.moves[0], (1, 0): field.moves[1], (1, 1): field.moves[2]}[before, tags[i]]
        p = np.exp(worth)
        total += p
        own += p * np.array(tags)
    assert np.allclose(field.marginals(slots, opens), own / total)


def test_learning_climbs_the_likelihood_of_all_taggings():
    """The fitted field gives the taggings of its windows more chance, by sums over all taggings, than one without weights."""
    rng = np.random.default_rng(3)
    y = (rng.random((40, 6)) < 0.4).astype(np.int8)
    size = rng.integers(3, 7, 40)
    slots = np.where(y[:, :, None] == 1, 10, 20).astype(np.int32) + rng.integers(0, 3, (40, 6, 2)).astype(np.int32)
    field = toxicity.fit_field(slots, y, size, rounds=40)

    def chance(f):
        out = 0.0
        for s, t, n in zip(slots, y, size, strict=True):
            score = lambda tags: sum(f.weights[s[i]].sum() * tags[i] + (f.moves[0] if tags[i] > (tags[i - 1] if i else 0) else f.moves[1] if i and tags[i] < tags[i - 1] else f.moves[2] if i and tags[i] and tags[i - 1] else 0.0) for i in range(n))  # noqa: B023, E731
            out += score(t[:n].astype(int)) - np.log(sum(np.exp(score(tags)) for tags in itertools.product((0, 1), repeat=int(n))))
        return out

    assert chance(field) > 0.5 * chance(toxicity.Field(np.zeros(1 << toxicity.HASH_BITS), np.array([-2.0, 0.0, 0.0]), np.zeros(4)))


def test_labels_of_equal_texts_are_settled_by_a_rule(spark):
    """However rows are dealt, the same texts are toxic: where labels of a text disagree, toxic holds."""
    rows = [(i, f"Das ist ein Satz mit {w}. Nummer {i % 6}.") for i, w in enumerate(["Schurke", "Katze"] * 24)]
    labels = [(i, i % 2 == 0 and i % 5 != 0) for i, _ in rows]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(v)) for i, v in labels], "doc_id long, toxic int")
    runs = [{r["doc_id"]: r["score"] for r in toxicity.classify(docs.repartition(n), known.repartition(n)).collect()} for n in (1, 3)]
    assert runs[0] == runs[1]


def test_labels_without_documents_use_up_no_room(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "$$ ## bad") for i in range(40)] + [(1, "again one")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    sample = quality.labelled(docs, labels, 10).collect()
    assert len(sample) == 20 and len({r["key"] for r in sample}) == 20


def test_quality_keeps_clashing_columns_under_other_names(docs, labels):
    rows = quality.classify(docs, labels, into=("worth", "fine")).collect()
    assert all(r["score"] == 0.5 for r in rows) and all(r["fine"] == (r["worth"] >= 0.7) for r in rows)
