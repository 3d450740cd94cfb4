"""The pipeline, stage by stage over awkward rows, and as a whole against plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from flowlens.llm import quality

from .brute import brute_lines, brute_links, brute_mix, words
from .conftest import ROWS, prose

STAGES = dict(P.STAGES)
CLASHING = "doc_id long, text string, lang string, source string, score double, predicted int, n_removed long, _row string"


@pytest.fixture(scope="module")
def folder(labels, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    docs.select("doc_id", "text").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0.25, 7, 8, "own") for r in ROWS], CLASHING)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_return_the_columns_and_rows_of_their_input(spark, folder, awkward, name):
    got = STAGES[name](spark, awkward, folder)
    assert got.dtypes == awkward.dtypes
    assert {(r["score"], r["predicted"], r["n_removed"], r["_row"]) for r in got.collect()} <= {(0.25, 7, 8, "own")}
    assert STAGES[name](spark, awkward.limit(0), folder).count() == 0


def test_one_of_each_class_stays(spark, awkward, folder):
    _, group = brute_links(ROWS)
    heads = Counter()
    for g in set(group):
        own = [r for r, k in zip(ROWS, group, strict=True) if k == g]
        if words(own[0][1]):
            own = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
            heads[own[0][0], own[0][1]] += 1
    heads += Counter((r[0], r[1]) for r in ROWS if not words(r[1]))
    assert Counter((r["doc_id"], r["text"]) for r in P.keep_one_of_each(spark, awkward, folder).collect()) == heads


def test_one_of_each_where_ids_are_shared(spark, folder):
    rows = [(1, prose(60, 1), "b"), (1, prose(60, 1), "a"), (1, prose(60, 2), "a"), (None, prose(60, 3), "a"), (None, prose(60, 4), "a"), (2, prose(60, 1), "a"), (3, None, "a"), (3, "", "a")]
    got = P.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), folder).collect()
    assert Counter(r["text"] for r in got) == Counter(r[1] for r in rows[1:] if r[0] != 2)
    assert [r["doc_id"] for r in got if r["text"] == rows[0][1]] == [1]


def test_run_equals_plain_loops(spark, tmp_path):
    rows = []
    for i in range(90):
        text = prose(60 + i, i // 2 if i % 3 == 0 else 100 + i) + ("\nAll rights reserved" if i % 2 else "") if i % 4 else f"$$ && {i} ## !! <<" * 20
        rows.append((i, text, "en", f"s{i % 7}" if i % 9 else None, len(text)))
    rows += [rows[1], rows[2], (100, None, "en", "s1", 0), (101, "", "en", "s1", 0), (None, prose(70, 500), "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(r) for r in P.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    ranking = quality.train(quality.labelled(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~quality.in_fold("doc_id", 4, 2)), 6000))
    of = lambda text: float(ranking.score(quality.features([text]))[0])
    good = [r[:2] + r[3:] for r in rows if of(r[1]) >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows)
    clean = [(r[0], text, *r[2:]) for r, (text, _) in zip(good, brute_lines(good), strict=True)]
    _, group = brute_links(clean)
    heads = {}
    for r, g in zip(clean, group, strict=True):
        heads.setdefault(g, []).append(r)
    one = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in heads.values()]
    taken, _ = brute_mix(one, lambda text: float(ranking.score(quality.features([text]))[0]))
    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (key, text, times), n in taken.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n * times
    assert got == +want
