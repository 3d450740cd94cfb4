"""Quality rules: counts of a text, and perplexity bands by language under a modified Kneser-Ney model.

The model is over UTF-16 units as they stand, but that a run of white space is one space; an n-gram of ORDER units is a 64-bit
number, so no two characters are taken for one. Spark counts n-grams of all texts, adding up what each batch has counted, and makes
the model of every language by aggregates and joins: lower orders count different left neighbours, discounts come from the counts of
all counts, and nothing is left out at any size. As every text is counted, each n-gram that is looked up has a probability of its own.

Probabilities are kept as arrays sorted by a hash of language and n-gram, and looked up by binary search. Documents are scored in
waves of languages whose models have about `wave` n-grams together; a larger model is cut by hash into slices of that size, and what
the slices give of a text is added up. So what is broadcast at once has a bound, while text is read once for each slice of its model.

A document's perplexity is exp of its mean negative log probability. Of the documents of a model that pass the base rules,
quartiles of log perplexity give the band: `reach` interquartile ranges (`least_range` at least) below and above. Documents
outside their band are rejected. Counts and quartiles take each different text of a model once, so that a text with many copies
neither shapes the model nor narrows the band; otherwise all statistics cover all documents.

Null texts count as empty; a text without words has perplexity 1 and fails the base rules. A null language is a language.
Every row gives one row, repeated rows too. An empty table gives no rows; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._spark import cut
from flowlens.llm._text import inside, mix, windows, words

ORDER, BITS = 4, 16
SYMBOLS = b"#*$%&|<>"
BLANK = 0x20
_BLANKS = np.array([chr(c).isspace() for c in range(1 << BITS)])


def _low(order: int) -> np.uint64:
    """Mask of the last `order` units of an n-gram."""
    return np.uint64((1 << (BITS * order)) - 1)


def grams(texts: list[str | None], chunk: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, n, document (0 to n - 1) and n-gram of ORDER units (uint64) of each place; before a text there are zeros."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size < chunk and i < len(texts) - 1:
            continue
        raw = [np.frombuffer((x or "").encode("utf-16-le", "surrogatepass") + b" \0", np.uint16) for x in texts[at : i + 1]]
        unit, doc = np.concatenate(raw), np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        blank = _BLANKS[unit]
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1] & (doc[1:] == doc[:-1])
        unit, doc = np.where(blank, BLANK, unit)[keep].astype(np.uint64), doc[keep]
        place = np.arange(len(unit)) - np.searchsorted(doc, np.arange(len(raw)))[doc]
        code = unit.copy()
        for j in range(1, ORDER):
            code[j:] |= np.where(place[j:] >= j, unit[:-j] << np.uint64(BITS * j), np.uint64(0))
        yield at, len(raw), doc, code
        at, size = i + 1, 0


def count_grams(df: DataFrame) -> DataFrame:
    """model, gram, n from rows of model and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for model, own in b.groupby("model"):
                seen = [np.unique(code, return_counts=True) for _, _, _, code in grams(list(own["text"]))]
                gram, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in seen)]), return_inverse=True)
                n = np.bincount(where, np.concatenate([np.zeros(0, np.int64), *(k for _, k in seen)]), len(gram)).astype(np.int64)
                yield pd.DataFrame({"model": np.int32(model), "gram": gram.view(np.int64), "n": n})

    return df.select("model", "text").mapInPandas(run, "model int, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def address(model, order: int, gram: np.ndarray) -> np.ndarray:
    return mix(np.asarray(gram, np.uint64) ^ mix(np.array([int(model) * (ORDER + 1) + order + 1], np.uint64)))


class KneserNey(NamedTuple):
    """The whole model of a few texts, for n-grams of other texts too. address: sorted; of each n-gram its probability (NaN: only seen as a context), and the weight that it leaves to shorter ones as a context."""

    address: np.ndarray
    probability: np.ndarray
    rest: np.ndarray

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.address):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.address, key), len(self.address) - 1)
        return at, self.address[at] == key

    def log_probability(self, model: int, gram: np.ndarray) -> np.ndarray:
        """Of the last kind of each n-gram after the others."""
        gram = np.asarray(gram, np.uint64)
        out = np.full(len(gram), 1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            own = gram & _low(order)
            at, seen = self._find(address(model, order, own))
            context, known = self._find(address(model, order - 1, own >> np.uint64(BITS)))
            share = np.where(known, self.rest[context], 1.0) if len(self.rest) else 1.0
            if len(self.rest):
                own_probability = np.where(seen, self.probability[at], np.nan)
                out = np.where(np.isnan(own_probability), out * share, own_probability)
        return np.log(out)


def discounts(n: np.ndarray) -> np.ndarray:
    """Taken from counts 0, 1, 2 and more, after counts of counts."""
    c = [float((n == k).sum()) for k in range(1, 5)]
    if not c[0]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = c[0] / (c[0] + 2 * c[1])
    d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])


def kneser_ney(counts: pd.DataFrame) -> KneserNey:
    """The interpolated model of the counts of count_grams()."""
    keys, probs, rests = [], [], []
    for model, own in counts.groupby("model"):
        gram = own["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(gram)
        levels = [(gram[order], own["n"].to_numpy(np.int64)[order])]
        for order in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & _low(order), return_counts=True))
        lower = np.full(1, 1.0 / (1 << BITS))
        lower_gram = np.zeros(1, np.uint64)
        for order, (gram, n) in enumerate(reversed(levels), 1):
            d = discounts(n)
            cut_off = d[np.minimum(n, 3)]
            context, where = np.unique(gram >> np.uint64(BITS), return_inverse=True)
            total, saved = np.bincount(where, n), np.bincount(where, cut_off)
            rest = saved / total
            suffix = gram & _low(order - 1)
            base = lower[np.searchsorted(lower_gram, suffix)]
            p = (n - cut_off) / total[where] + rest[where] * base
            keys.append(address(model, order, gram))
            probs.append(p)
            rests.append(np.ones(len(gram)))
            if order == 1:
                keys.insert(-1, address(model, 0, context))
                probs.insert(-1, np.full(1, 1.0 / (1 << BITS)))
                rests.insert(-1, rest)
            else:  # contexts are n-grams of the order below
                at = np.searchsorted(lower_gram, context)
                hit = (at < len(lower_gram)) & (lower_gram[np.minimum(at, len(lower_gram) - 1)] == context)
                rests[-2][at[hit]] = rest[hit]
                extra = context[~hit]  # begins of texts, that nothing stands before
                keys.append(address(model, order - 1, extra))
                probs.append(np.full(len(extra), np.nan))
                rests.append(rest[~hit])
                keys[-2], keys[-1], probs[-2], probs[-1], rests[-2], rests[-1] = keys[-1], keys[-2], probs[-1], probs[-2], rests[-1], rests[-2]
            lower, lower_gram = p, gram
    key = np.concatenate(keys or [np.zeros(0, np.uint64)])
    order = np.argsort(key)
    join = lambda x: np.concatenate(x or [np.zeros(0)])[order]
    return KneserNey(key[order], join(probs), join(rests))


def base_counts(texts: list[str | None]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = [np.zeros((0, 5), np.int64)]
    for w in words(texts):
        solid = np.repeat(np.tile([False, True], len(w.start)), np.diff(np.concatenate([[0], np.stack([w.start, w.end], 1).ravel()]))) if len(w.start) else np.zeros(0, bool)
        solid = np.concatenate([solid, np.zeros(len(w.buf) - len(solid), bool)])
        per = lambda x: np.add.reduceat(x.astype(np.int64), w.begin[:-1])
        doc = w.doc()
        gram, within = windows(w.key, 3), inside(w, 3)
        at = np.flatnonzero(within)
        own = gram[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marked = np.zeros(len(w.key), bool)
        for j in range(3):
            marked[at[order[twice]] + j] = True
        dup = []
        for t in texts[w.first : w.first + w.n]:
            lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
            dup.append(len(lines) - len(set(lines)))
        out.append(np.column_stack([np.diff(w.at), per(solid & ((w.buf & 0xC0) != 0x80)), per(symbol[w.buf]), np.array(dup, np.int64), np.bincount(doc[marked], minlength=w.n)]))
    return np.vstack(out)


def models(df: DataFrame) -> DataFrame:
    """lang and model of every language: numbers from 0 by how many rows it has."""
    counts = df.groupBy("lang").agg(F.count("*").alias("rows"))
    return counts.select("lang", (F.row_number().over(Window.orderBy(F.desc("rows"), F.col("lang").asc_nulls_last())) - 1).alias("model"))


def taken(levels: dict[int, DataFrame]) -> DataFrame:
    """model, order and d, discounts() of all counts of an order."""
    parts = [own.groupBy("model").agg(F.array(*(F.count_if(F.col("n") == k) for k in range(1, 5))).alias("c")).withColumn("order", F.lit(order)) for order, own in levels.items()]
    c = lambda k: F.col("c")[k - 1]
    y = c(1) / (c(1) + 2 * c(2))
    d = lambda k: F.when(c(1) == 0, 0.5).otherwise(F.greatest(F.least(F.when(c(k) > 0, k - (k + 1) * y * c(k + 1) / c(k)).otherwise(0.5), F.lit(k - 0.05)), F.lit(0.05)))
    return reduce(DataFrame.unionByName, parts).select("model", "order", F.array(d(1), d(2), d(3)).alias("d"))


def probabilities(counts: DataFrame) -> DataFrame:
    """model, gram and log_p of every n-gram of counts (model, gram, n): the interpolated model, order by order from single units up."""
    levels = {ORDER: cut(counts)}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(int(_low(order)))).alias("gram")
        levels[order] = cut(levels[order + 1].select("model", shorter).groupBy("model", "gram").agg(F.count("*").alias("n")))
    off = cut(taken(levels))
    lower = None
    for order in range(1, ORDER + 1):
        own = levels[order].join(off.where(F.col("order") == order).drop("order"), "model")
        own = own.withColumns({"off": F.col("d")[F.least("n", F.lit(3)).cast("int") - 1], "context": F.shiftrightunsigned("gram", BITS)}).drop("d")
        totals = own.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("saved"))
        own = own.join(totals, ["model", "context"])
        if lower is None:
            own = own.withColumn("base", F.lit(1.0 / (1 << BITS)))
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(int(_low(order - 1)))))
            own = own.join(lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("base")), ["model", "suffix"])
        lower = cut(own.select("model", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("saved") / F.col("total") * F.col("base")).alias("p")))
    return lower.select("model", "gram", F.log("p").alias("log_p"))


class Slice(NamedTuple):
    """address: sorted; log_p of each. N-grams of other slices count nothing."""

    address: np.ndarray
    log_p: np.ndarray

    def log_probability(self, model: int, gram: np.ndarray) -> np.ndarray:
        key = address(model, ORDER, gram)
        at = np.minimum(np.searchsorted(self.address, key), max(len(self.address) - 1, 0))
        return np.where(self.address[at] == key, self.log_p[at], 0.0) if len(self.address) else np.zeros(len(key))


def sliced(own: pd.DataFrame) -> Slice:
    """One slice of the rows of probabilities()."""
    gram, model = own["gram"].to_numpy(np.int64).view(np.uint64), own["model"].to_numpy()
    key = np.concatenate([np.zeros(0, np.uint64), *(address(m, ORDER, gram[model == m]) for m in np.unique(model))])
    value = np.concatenate([np.zeros(0), *(own["log_p"].to_numpy(np.float64)[model == m] for m in np.unique(model))])
    order = np.argsort(key)
    return Slice(key[order], value[order])


class Known:
    """Log probabilities of n-grams looked up before, by model: sorted n-grams, at most `most`."""

    def __init__(self, model: Slice, most: int = 1 << 21):
        self.model, self.most, self.kept = model, most, {}

    def of(self, m: int, code: np.ndarray) -> np.ndarray:
        gram, value = self.kept.get(m, (np.zeros(0, np.uint64), np.zeros(0)))
        at = np.minimum(np.searchsorted(gram, code), max(len(gram) - 1, 0))
        new = np.unique(code[gram[at] != code]) if len(gram) else np.unique(code)
        if len(new):
            if len(gram) + len(new) > self.most:
                gram, value, new = gram[:0], value[:0], np.unique(code)
            gram, value = np.concatenate([gram, new]), np.concatenate([value, self.model.log_probability(m, new)])
            order = np.argsort(gram)
            self.kept[m] = gram, value = gram[order], value[order]
            at = np.searchsorted(gram, code)
        return value[at]


def judge(df: DataFrame, wave: int = 1 << 21, reach: float = 3.0, least_range: float = 0.02) -> DataFrame:
    """doc_id, the counts of base_counts(), base_failed, perplexity, low and high (its band) and kept of each row."""
    spark = df.sparkSession
    names = cut(models(df))
    source = df.select("doc_id", F.col("lang").alias("own"), "text", F.md5(F.col("text").cast("binary")).alias("key"))
    named = lambda some: source.join(some, F.col("own").eqNullSafe(F.col("lang"))).select("doc_id", "text", "key", "model")
    known_grams = cut(probabilities(count_grams(named(names).dropDuplicates(["model", "key"]))))
    sizes = names.join(known_grams.groupBy("model").agg(F.count("*").alias("n")), "model", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.sum("n").over(Window.orderBy("model")) - F.col("n")
    slices = F.greatest(F.ceil(F.col("n") / wave), F.lit(1))
    waves = cut(sizes.select("lang", "model", slices.alias("slices"), F.when(slices > 1, -1 - F.col("model")).otherwise(F.floor(before / wave)).alias("wave")))

    def scores(batches: Iterator[pd.DataFrame], shared) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        known = Known(shared.value)
        for b in batches:
            b = b.reset_index(drop=True)
            sums, places = np.zeros(len(b)), np.zeros(len(b))
            for m, own in b.groupby("model"):
                for first, n, doc, code in grams(list(own["text"])):
                    at = own.index.to_numpy()[first : first + n]
                    sums[at] = np.bincount(doc, known.of(int(m), code), n)
                    places[at] = np.bincount(doc, minlength=n)
            yield b, sums, places

    def whole(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        for b, sums, places in scores(batches, shared):
            out = pd.DataFrame(base_counts(list(b["text"])), columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            yield out.assign(doc_id=b["doc_id"], key=b["key"], model=b["model"].astype(np.int32), sums=sums, places=places)

    def rest(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        for b, sums, _ in scores(batches, shared):
            yield pd.DataFrame({"key": b["key"], "model": b["model"].astype(np.int32), "more": sums})

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_id {kind}, key string, model int, sums double, places double"
    parts, others = [], []
    for k, n in waves.groupBy("wave").agg(F.max("slices")).orderBy("wave").collect() or [(0, 1)]:
        some = waves.where(F.col("wave") == k).select("lang", "model")
        held = known_grams.join(some.select("model"), "model", "left_semi")
        for piece in range(n):
            own = held if n == 1 else held.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == piece)
            shared = spark.sparkContext.broadcast(sliced(own.toPandas()))  # about `wave` rows, with one small model more at most
            if piece == 0:
                parts.append(cut(named(some).mapInPandas(lambda b, shared=shared: whole(b, shared), schema)))
            else:
                texts = named(some).dropDuplicates(["model", "key"])
                others.append(cut(texts.mapInPandas(lambda b, shared=shared: rest(b, shared), "key string, model int, more double")))
            shared.destroy()
    scored = reduce(DataFrame.unionByName, parts)
    if others:
        more = cut(reduce(DataFrame.unionByName, others).groupBy("model", F.coalesce("key", F.lit("")).alias("_key")).agg(F.sum("more").alias("more")))
        scored = scored.withColumn("_key", F.coalesce("key", F.lit(""))).join(more, ["model", "_key"], "left").withColumn("sums", F.col("sums") + F.coalesce("more", F.lit(0.0)))
    scored = scored.withColumn("log_perplexity", F.when(F.col("n_words") > 0, -F.col("sums") / F.greatest("places", F.lit(1.0))).otherwise(0.0))
    scored = scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    q = F.percentile(F.round("log_perplexity", 3), F.array(F.lit(0.25), F.lit(0.75)))
    texts = scored.where(~F.col("base_failed")).groupBy("model", "key").agg(F.first("log_perplexity").alias("log_perplexity"))
    bands = texts.groupBy("model").agg(q.alias("q"))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least_range)) * reach
    bands = bands.select("model", (F.col("q")[0] - width).alias("low"), (F.col("q")[1] + width).alias("high"))
    out = scored.join(cut(bands), "model", "left")  # a row of each language
    within = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.exp(a).alias(b) for a, b in (("log_perplexity", "perplexity"), ("low", "low"), ("high", "high"))))
