"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, against plain code."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import bpe, jaccard, lines, merkle, mixing, perplexity, quality, sharding, substrings, toxicity

from .brute import brute_links, brute_mix, words
from .conftest import LONG, ROWS, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe(docs, nothing):
    source = bpe.read_tokenizer(VOCABULARY)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, source).collect())
    t = Tokenizer.from_file(VOCABULARY)
    want = []
    for key, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((key or 0, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and bpe.round_trip(nothing, source).count() == 0
    again = bpe.decode(bpe.encode(docs, source), source)
    assert again.where("decoded <> coalesce(text, '')").count() == 0 and again.count() == len(ROWS)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|endoftext|>", "aaaaaaa", "  \n\n x\t\ty  ", "日本語 🎉 é", "it's 'll 123abc", "\x1c a\x85b\xa0c²", "x" * 5000, "a\r\n\r\nB"])
def test_bpe_texts(text):
    b, t = bpe.ForcedBoundaryBpe(bpe.read_tokenizer(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    (ids,) = b.encode([text])
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and b.decode(ids.tolist()) == text


def test_quality(docs, nothing, labels):
    rows = quality.classify(docs.drop("score"), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in quality.classify(docs.drop("score"), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_toxicity(docs, nothing, labels):
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(nothing, labels).count() == 0


def test_toxic_words_are_found_with_their_places(spark):
    clean = [(i, f"Die {w}e kam an und ging dann wieder heim. Nummer {i}.", 0) for i, w in enumerate(["Katze", "Maus", "Kuh", "Ente"] * 10)]
    toxic = [(100 + i, f"Er sagte, du Schurk{e} bist hier. Dann ging er heim. Nummer {i}.", 1) for i, e in enumerate(["", "isch", "erei", "en"] * 10)]
    rows = [*clean, *toxic]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = toxicity.classify(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    for r in found.join(docs, "doc_id").collect():
        assert r["predicted"] == (r["doc_id"] >= 100)
        if r["doc_id"] >= 100:
            assert any(r["text"][s["begin"] : s["end"]].find("Schurk") >= 0 for s in r["spans"])


def test_perplexity_counts(docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in perplexity.judge(docs).collect())
    want = Counter()
    for key, text, *_ in ROWS:
        w = words(text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        own = [x for x in (text or "").split("\n") if words(x)]
        want[key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert got == want and perplexity.judge(nothing).count() == 0


def test_perplexity_of_clean_texts_beside_many_copies(spark):
    copied = " ".join(f"{a}{b}" for a in "zyxwvutsrq" for b in "bcdfghjklm")
    rows = [(i, prose(80, i), "de" if i % 6 == 0 else "en") for i in range(120)] + [(200 + i, copied, "de") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(got[i] for i in range(120))


def test_perplexity_has_a_model_and_a_band_of_every_language(spark):
    rows = [(100 * k + i, prose(60, 100 * k + i).translate({97 + j: 97 + (j * (2 * k + 1)) % 26 for j in range(26)}), f"l{k}") for k in range(20) for i in range(6)] + [(5000, prose(60, 1), None), (5001, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.judge(df, wave=3000).collect()}
    assert set(got) == {r[0] for r in rows} and len({(got[100 * k]["low"], got[100 * k]["high"]) for k in range(20)}) == 20
    for k in (0, 17, 19):
        for r in perplexity.judge(df.where(f"lang = 'l{k}'")).collect():
            assert r == got[r["doc_id"]]


def test_perplexity_tells_all_characters_apart():
    texts = ["\U0001e922\U0001e923\U0001e924", "\u0434\u0440\u0443", "\u0414\u0440\u0443", "\u6f22\u5b57", "123", "456", "ab  \n c", "ab c"]
    found = [[tuple(int(x) for x in code[doc == d]) for d in range(n)] for _, n, doc, code in perplexity.grams(texts)][0]
    assert len(set(found)) == len(texts) - 1 and found[-1] == found[-2] and found[3][0] == 0x6F22 and found[7][3] == 0x0061_0062_0020_0063


def plain_kneser_ney(texts, order=4, kinds=1 << 16):
    """Probability of a unit after a context of order - 1 units, by dictionaries: modified Kneser-Ney as a text book has it."""
    runs = [[0] * (order - 1) + list(np.frombuffer((" ".join(t.split()) + " ").encode("utf-16-le"), np.uint16).tolist()) for t in texts]
    counts = {order: Counter(tuple(r[i : i + order]) for r in runs for i in range(len(r) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    taken = {n: perplexity.discounts(np.array(list(c.values()))) for n, c in counts.items()}

    def chance(gram):
        n = len(gram)
        if not n:
            return 1.0 / kinds
        beside = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not beside:
            return chance(gram[1:])
        total, off = sum(beside.values()), taken[n]
        own = beside.get(gram, 0)
        return (own - off[min(own, 3)] + sum(off[min(c, 3)] for c in beside.values()) * chance(gram[1:])) / total

    return chance


def test_perplexity_equals_plain_counting(spark):
    texts = ["der hund und die katze", "die katze und der hund bellt", "ABC 12!", "\u6f22\u5b57 \u6f22"]
    codes = Counter(int(c) for _, _, _, code in perplexity.grams([*texts, "", None]) for c in code)
    model = perplexity.kneser_ney(pd.DataFrame({"model": 0, "gram": np.array(list(codes), np.uint64).view(np.int64), "n": list(codes.values())}))
    chance = plain_kneser_ney(texts)
    for code in [*codes, 0x0064_0065_0072_0078, 0x0078_0078_0078_0064, 0x0020_0064_0065_006E]:
        gram = tuple(code >> s & 0xFFFF for s in (48, 32, 16, 0))
        assert abs(np.exp(model.log_probability(0, np.array([code], np.uint64)))[0] - chance(gram)) < 1e-12
    for context in (0, int(next(iter(codes))) >> perplexity.BITS, 12345):
        assert abs(np.exp(model.log_probability(0, np.uint64(context << 16) + np.arange(1 << 16, dtype=np.uint64))).sum() - 1) < 1e-9
    assert perplexity.base_counts(["a b c a b c\n\nx #\nx #"]).tolist() == [[10, 10, 2, 1, 6]]


def plain_log_p(texts):
    codes = Counter(int(c) for _, _, _, code in perplexity.grams(texts) for c in code)
    gram = np.array(list(codes), np.uint64)
    own = pd.DataFrame({"model": 0, "gram": gram.view(np.int64), "n": list(codes.values())})
    return own, dict(zip(own["gram"].tolist(), perplexity.kneser_ney(own).log_probability(0, gram).tolist(), strict=True))


def test_perplexity_model_of_spark_equals_the_model_in_memory(spark):
    """Two models at once; the last text has units above 2**15, whose n-grams are negative as long."""
    counts, want = [], {}
    for m, texts in enumerate([[prose(300, 5), prose(90, 6)], ["\uf222\uff57 \u6f22\uf222\uff57", "a"]]):
        own, told = plain_log_p(texts)
        counts.append(own.assign(model=m))
        want |= {(m, g): p for g, p in told.items()}
    got = {(r["model"], r["gram"]): r["log_p"] for r in perplexity.probabilities(spark.createDataFrame(pd.concat(counts), "model int, gram long, n long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_perplexity_of_more_than_a_million_places(spark):
    """As shipped, above 2**20 n-grams of a language: every n-gram counts, and small slices give what one model gives."""
    rows = [(i, prose(6000, i) + f" only{i}", "en") for i in range(24)]
    own, told = plain_log_p([r[1] for r in rows])
    assert own["n"].sum() > 1 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in perplexity.judge(df).collect()}
    again = {r["doc_id"]: r for r in perplexity.judge(df, wave=len(told) // 3).collect()}
    for key, text, _ in rows:
        ((_, _, _, code),) = perplexity.grams([text])
        want = -np.mean([told[int(np.int64(np.uint64(c).view(np.int64)))] for c in code])
        assert abs(math.log(got[key]["perplexity"]) - want) < 1e-9 and abs(math.log(again[key]["perplexity"]) - want) < 1e-9
        assert got[key]["kept"] == again[key]["kept"]


def test_perplexity_bands(spark):
    """perplexity, low, high and kept of every row, from the plain model and the definition of the band."""
    rows = [(i, prose(55 + i, i), "en" if i % 3 else "de") for i in range(24)] + [(100, "zq " * 60 + prose(50, 3), "en"), (101, "short", "de"), (102, None, "de")]
    got = {r["doc_id"]: r for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for lang in ("en", "de"):
        own = [r for r in rows if r[2] == lang]
        codes = Counter(int(c) for _, _, _, code in perplexity.grams([r[1] for r in own]) for c in code)
        model = perplexity.kneser_ney(pd.DataFrame({"model": 0, "gram": np.array(list(codes), np.uint64).view(np.int64), "n": list(codes.values())}))
        logs = {key: -float(np.mean(model.log_probability(0, code))) if words(text) else 0.0 for key, text, _ in own for _, _, _, code in perplexity.grams([text])}
        low, high = np.percentile([round(logs[key], 3) for key, *_ in own if not got[key]["base_failed"]], [25, 75])
        width = 3 * max(high - low, 0.02)
        for key, *_ in own:
            r = got[key]
            assert abs(math.log(r["perplexity"]) - logs[key]) < 1e-9 and abs(math.log(r["low"]) - (low - width)) < 1e-9 and abs(math.log(r["high"]) - (high + width)) < 1e-9
            assert r["kept"] == (not r["base_failed"] and low - width <= logs[key] <= high + width)


def test_lines(spark, nothing):
    rows = [(i, f"All rights are reserved.\nown line number {i} here\nand one more line {i}", f"s{i % 8}") for i in range(40)]
    rows += [(50 + i, "first line of a copy\nsecond line of a copy", f"s{i}") for i in range(8)] + [(60, None, "s1"), (61, "", None), (62, "All rights are reserved.", None)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, source string, n_chars long, hash string")
    got = {r["doc_id"]: r for r in lines.remove_boilerplate(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"own line number {i} here\nand one more line {i}" and got[i]["n_removed"] == 1 and got[i]["n_chars"] == len(got[i]["text"]) for i in range(40))
    assert all(got[50 + i]["text"] == rows[40 + i][1] for i in range(8))  # copies stay whole
    assert got[60]["text"] is None and got[61]["text"] == "" and got[62]["text"] == "All rights are reserved."
    assert lines.remove_boilerplate(nothing).count() == 0


def test_lines_go_whatever_their_share(spark):
    footer = "\n".join(f"Clause {k} of the licence that every page carries" for k in range(9))
    rows = [(i, f"Short page {i}\n{footer}", f"s{i}") for i in range(8)] + [(20 + i, f"{footer}\nCopied page", f"s{i}") for i in range(6)] + [(30, f"{footer}\n \n", "s1")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (f"Short page {i}", 9) for i in range(8))
    assert all(got[i] == (text, 0) for i, text, _ in rows[8:])  # copies on six sites, and a page of nothing else


def test_merkle(docs, nothing):
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"] == 1.0) for r in merkle.compare_with_edit(docs).collect())
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1])))
    want = Counter()
    for (key, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + (after or "")[:half]
        want[key, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited == text] += 1
    assert got == want and merkle.compare_with_edit(nothing).count() == 0


def brute_common(a, b):
    """Spans in common of two trees by longest common subsequences (quadratic) of sections, of paragraphs between these, of spans between those."""

    def lcs(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                yield i, j
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1

    def go(x, y, level):
        names = [v if level == 2 else v.node for v in x], [v if level == 2 else v.node for v in y]
        total = i = j = 0
        for p, q in [*lcs(*names), (len(x), len(y))]:
            if level < 2:
                below = lambda run: [c for v in run for c in (v.paragraphs if level == 0 else v.spans)]
                total += go(below(x[i:p]), below(y[j:q]), level + 1)
                total += x[p].size if p < len(x) else 0
            else:
                total += p < len(x)
            i, j = p + 1, q + 1
        return total

    return go(list(a.sections), list(b.sections), 0)


def test_merkle_branches():
    a, b, c, empty = merkle.trees(["one two three\nfour five six\nseven eight", "one two three\nfour FIVE six\nseven eight", "one two three\nfour five six\nseven eight", ""])
    assert a.text() == c.text() and a.root != b.root and merkle.likeness(a, c) == 1.0 and 0 < merkle.likeness(a, b) < 1 and merkle.likeness(a, empty) == 0
    assert merkle.edits(a.text(), b.text()) == [(1, 2, 1, 2)] and merkle.edits(a, c) == []
    assert all(merkle.read(t.text()) == t for t in (a, b, empty))


@pytest.mark.parametrize("seed", range(6))
def test_merkle_likeness_and_located_edits(seed):
    old = [" ".join(f"w{seed}_{k}_{j}" for j in range(4 + (7 * k + seed) % 30)) for k in range(60)]
    new = list(old)
    new[10 + seed] = "another paragraph"
    new[40:43] = ["one for three", "and another"]
    new.insert(55, "put in")
    a, b = merkle.trees(["\n".join(old), "\n".join(new)])
    assert merkle.edits(a, b) == [(10 + seed, 11 + seed, 10 + seed, 11 + seed), (40, 43, 40, 42), (56, 56, 55, 56)]
    assert merkle.likeness(a, b) == merkle.likeness(a.text(), b.text()) == 2 * brute_common(a, b) / (a.size + b.size)
    moved = merkle.trees(["\n".join(old[30:] + old[:30])])[0]
    assert moved.root != a.root and merkle.likeness(a, moved) < 0.8


@pytest.mark.parametrize(("kind", "ids"), [("string", ["b", "a", None, "10", "9", "a"]), ("long", [2**60 + 1, 2**60, None, -(2**63), 2**63 - 1, 5]), ("string", ["only"])])
def test_merkle_ids_of_any_type(spark, kind, ids):
    rows = [(key, f"text {i} of\nsome lines") for i, key in enumerate(ids)]
    order = sorted(rows, key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    order = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want[key, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    got = merkle.compare_with_edit(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3))
    assert got.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind) and Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want


def test_merkle_where_ids_and_texts_are_shared(spark):
    rows = [(7, "a copied text of some words")] * 40 + [(7, f"text {i} of one id") for i in range(30)] + [(None, f"no id {i}") for i in range(25)] + [(i, f"own {i}\nline") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = Counter()
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want[key, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest(), round(merkle.likeness(*merkle.trees([text, after])), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_next"], 9)) for r in merkle.compare_with_edit(df).collect()) == want


@pytest.mark.parametrize("copies", [3, 40])
def test_sharding(spark, nothing, docs, copies):
    rows = [(i, f"text {i}") for i in range(60)] + [(100 + i, "one copied text") for i in range(copies)] + [(200, None), (201, None), (202, ""), (203, ""), (None, "x")] + [(300, "a repeated row")] * copies
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    used = {r["shard"] for r in got if (r["doc_id"] or 0) in range(100, 200)}
    assert len(used) <= -(-copies // min(sizes.values())) + 1
    text = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in got)
    assert sharding.shard(nothing, 8).count() == 0 and sharding.shard(docs, 16).count() == len(ROWS)


def test_jaccard(spark, docs, nothing):
    n, group = brute_links(ROWS)
    got = sorted((r["doc_id"] or 0, r["n_links"]) for r in jaccard.join(docs).collect())
    assert got == sorted((r[0] or 0, k) for r, k in zip(ROWS, n, strict=True)) and jaccard.join(nothing).count() == 0
    rows = []
    for i in range(700):  # one large group of near copies, in more than one block, beside unrelated texts
        w = [f"w{k}" for k in range(80)]
        w[i % 80] = f"x{i}"
        rows.append((i, " ".join(w)) if i < 600 else (i, " ".join(f"v{i}_{k}" for k in range(40))))
    n, group = brute_links(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (group[i], n[i]) for i in range(700)}


@pytest.mark.parametrize("hot", [1, 2000])
def test_substrings(docs, nothing, hot):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs, 35, hot).collect())
    seen = Counter(tuple(w[i : i + 35]) for r in ROWS for w in [words(r[1])] for i in range(len(w) - 34))
    want = Counter()
    for key, text, *_ in ROWS:
        w = words(text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[key, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert got == want and substrings.remove_repeats(nothing).count() == 0
    assert want[6, 30_000, 0, hashlib.sha256(LONG.encode()).hexdigest()] == 1


@pytest.mark.parametrize("ids", [(1, 1, 1, 2), (7, 7, 8, 7), (None, None, None, None), (None, None, 3, 3)])
def test_substrings_where_ids_are_shared(spark, ids):
    common = prose(40, 5)
    texts = [f"{common} {prose(50, 6)}", f"{common} {prose(50, 6)}", prose(45, 7) + " " + common, common + " short"]
    rows = [*zip(ids, texts, strict=True), (ids[0], None), (ids[0], prose(30, 8))]
    got = Counter(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    seen = Counter(tuple(w[i : i + 35]) for _, text in rows for w in [words(text)] for i in range(len(w) - 34))
    want = Counter()
    for key, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[key, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert got == want


def test_mixing(spark, docs, nothing):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows) and mixing.taken(nothing).count() == 0
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 4 else None) for i in range(600)], "doc_id long, text string, source string")
    by = defaultdict(int)
    goal = {}
    first = mixing.taken(many).collect()
    source = {r["doc_id"]: r["source"] for r in many.collect()}
    for r in first:
        by[source[r["doc_id"]]] += r["taken"]
        goal[source[r["doc_id"]]] = r["target"]
    assert all(abs(by[s] - goal[s]) <= 4 for s in goal)
    assert sorted(first) == sorted(mixing.taken(many.repartition(5)).collect())
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns and mixed.selectExpr("sum(size(split(trim(text), ' ')))").first()[0] == sum(by.values())


TIED = [
    [(i, "w " * (5 + i), "a") for i in range(30)] + [(7, "one two three four five", "a")] * 90 + [(9, "x y", "b")] * 3 + [(10, "", "c")],
    [(None, "one two three", "a")] * 100 + [(i, f"w{i} v # u", None) for i in range(40)] + [(None, None, "b")],
    [(i, text, f"s{i % 2}") for i in range(25) for text in ("a b c", "a b c", "d e")],
]


@pytest.mark.parametrize("rows", [*TIED, [r[:2] + r[3:] for r in ROWS]])
def test_mixing_splits_ties_and_equals_plain_sorting(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, goal = brute_mix(rows)
    got = mixing.taken(df).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == sum((Counter({(key, len(words(text)), t * len(words(text))): n}) for (key, text, t), n in want.items()), Counter())
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(g, 6) for g in goal.values()})
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mix(df).collect())
    assert mixed == +sum((Counter({(key, text): n * t}) for (key, text, t), n in want.items()), Counter())


def test_mixing_tells_rows_apart_by_all_columns(spark):
    rows = [(None, "a b c", "s", f"l{i % 9}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    runs = [Counter(map(tuple, mixing.mix(df.repartition(n, "lang"), share=0.6).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 42


def test_mixing_takes_weights_from_a_column(spark):
    rows = [(i, "a b c d", "s", 1.0 if i % 2 else 0.01) for i in range(400)] + [(1000, "a b", "s", None)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string, worth double"), share=0.5, weight="worth").collect()
    assert sum(r["taken"] > 0 for r in got if r["doc_id"] % 2) > 4 * sum(r["taken"] > 0 for r in got if r["doc_id"] % 2 == 0)


def test_lines_keep_a_clashing_column_under_another_name(spark):
    rows = [(i, f"Menu\nown line {i}", f"s{i}", 77) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    assert {(r["text"], r["n_removed"], r["gone"]) for r in lines.remove_boilerplate(df, into="gone").collect()} == {(f"own line {i}", 77, 1) for i in range(8)}
    assert {(r["text"], r["n_removed"]) for r in lines.remove_boilerplate(df).collect()} == {(f"own line {i}", 1) for i in range(8)}


def test_lines_of_a_very_long_text(spark):
    body = "\n".join(x for i in range(20_000) for x in (f"line {i}", "Footer"))
    df = spark.createDataFrame([(0, body, "s0"), *((i, f"Footer\nown {i}", f"s{i}") for i in range(1, 7)), (1, "Footer\nown 1", "s1")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.remove_boilerplate(df).collect()}
    assert got == {0: ("\n".join(f"line {i}" for i in range(20_000)), 20_000)} | {i: (f"own {i}", 1) for i in range(1, 7)}


def test_substring_index_counts_as_plain_search():
    rng = np.random.default_rng(5)
    parts = [rng.zipf(1.4, 90) % 40 + 1 for _ in range(6)]
    parts.append(parts[0][20:80])
    text = np.concatenate([[0], *(np.append(p, 0) for p in parts)]).astype(np.int64)
    index = substrings.FmIndex(text, 12)
    for _ in range(200):
        at, n = int(rng.integers(1, len(text) - 13)), int(rng.integers(1, 12))
        pattern = text[at : at + n]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([index.size])
        for letter in pattern[::-1]:
            low, high = index.extend(np.array([letter]), low, high)
        assert high[0] - low[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))
    counts = np.bincount(text)
    share = counts[counts > 0] / len(text)
    assert (counts * index.tree.length).sum() / len(text) < min(-(share * np.log2(share)).sum() + 1, np.log2(len(counts)))
