"""N-gram Jaccard join by chosen paths.

A document is its set of shingles, runs of `shingle` words as they stand (all its words if it has fewer); documents with
equal sets are copies and enter once, with their number. The join finds the pairs of different sets with a Jaccard
similarity of `threshold` or more.

Each set has a sketch of POSITIONS MinHash tokens. A run starts with all sets in one bucket. A bucket samples token positions
by its own hash, 1 / threshold of them on average, and splits its sets by their tokens there, so similar sets stay together
on about one path at each level. A bucket of at most `small` sets is compared by brute force: sketches first, with room
for five standard errors, then the sets themselves. What is still larger at the last level, as sets of one near-copied
document are, is compared by brute force in blocks, bounded in sets and in shingles. Runs are repeated until a pair at the
threshold is found with probability `recall`, by the chances of its paths; as all runs sample from one sketch, chances are
averaged over how many of its positions agree.

A pair may meet in several buckets; only the largest one that both have counts it. A set's largest bucket is its home; sets
of one home are not compared elsewhere, and a bucket whose sets all have one home elsewhere is left out. Nothing emits pairs:
a bucket gives each set's number of links and a forest of links that joins what is linked. Those forests give classes, by
smallest-label propagation with jumps over joins of tables.

Null and empty texts have no shingles and no links, also not with each other. Repeated rows are copies. Sets are told
apart by a 63-bit hash of all their shingles. Every row gives one row, an empty table none; other columns don't matter. `one_of_each`
leaves one row of each class, and all rows without words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut, drop
from flowlens.llm._text import inside, mix, windows, words

POSITIONS = 64
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_FACTOR = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 62, POSITIONS, dtype=np.uint64)


def shingles(texts: list[str | None], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, n, and the sorted distinct shingle hashes of documents first to first + n - 1 with bounds (n + 1)."""
    for w in words(texts):
        doc, gram, within = w.doc(), windows(w.key, size), inside(w, size)
        key, of = gram[within], doc[: len(gram)][within]
        short = np.flatnonzero((np.diff(w.at) > 0) & (np.diff(w.at) < size))
        if len(short):
            whole = [mix(np.array([np.bitwise_xor.reduce(mix(w.key[w.at[d] : w.at[d + 1]] + np.arange(1, w.at[d + 1] - w.at[d] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))], np.uint64))[0] for d in short]
            key, of = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([of, short])
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, of = key[fresh], of[fresh]
        yield w.first, w.n, key, np.searchsorted(of, np.arange(w.n + 1))


def set_id(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """63-bit id of each set, not 0; 0 for an empty one."""
    if not len(key):
        return np.zeros(len(at) - 1, np.int64)
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    h = mix(a[at[1:]] - a[at[:-1]] + mix(np.diff(at).astype(np.uint64)))
    return np.where(np.diff(at) > 0, (h >> np.uint64(1)).astype(np.int64) | 1, 0)


def sketches(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint32 tokens (n, POSITIONS) of sets; empty sets have zeros."""
    n, out = len(at) - 1, np.zeros((len(at) - 1, POSITIONS), np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for j in range(POSITIONS):
            low = np.minimum.reduceat(key * _FACTOR[j] + _SHIFT[j], at[full])
            out[full, j] = (mix(low) >> np.uint64(32)).astype(np.uint32)
    return out[:n]


def documents(df: DataFrame, shingle: int) -> DataFrame:
    """id (of the set; 0: none), doc_id, hash (of the text), size (of the set) and sketch of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n, key, at in shingles(list(b["text"]), shingle):
                yield pd.DataFrame({"id": set_id(key, at), "doc_id": b["doc_id"].iloc[first : first + n].to_numpy(), "hash": b["hash"].iloc[first : first + n].to_numpy(), "size": np.diff(at), "sketch": [r.tobytes() for r in sketches(key, at)]})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), "text").mapInPandas(run, f"id long, doc_id {kind}, hash string, size long, sketch binary")


def sampled(bucket: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of the sampled positions of each bucket: 1 / threshold on average, whole numbers around it."""
    share = (mix(bucket.view(np.uint64) ^ np.uint64(0xC0FFEE)) >> np.uint64(11)).astype(float) / (1 << 53)
    n = np.floor(1 / threshold + share).astype(np.int64)
    rows, places = [], []
    for j in range(int(n.max()) if len(n) else 0):
        row = np.flatnonzero(n > j)
        start = mix(bucket[row].view(np.uint64) + np.uint64(77))
        step = (mix(bucket[row].view(np.uint64) + np.uint64(78)) % np.uint64(POSITIONS // 2)) * np.uint64(2) + np.uint64(1)
        rows.append(row)
        places.append(((start + np.uint64(j) * step) % np.uint64(POSITIONS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def miss(threshold: float, levels: int, runs: int) -> float:
    """Chance that a pair at the threshold meets in no bucket of the last level, over how many positions of its sketches agree."""
    low, share = math.floor(1 / threshold), 1 / threshold - math.floor(1 / threshold)
    total = 0.0
    for agree in range(POSITIONS + 1):
        p = 1.0
        for _ in range(levels):
            apart = 1 - agree / POSITIONS * p
            p = 1 - ((1 - share) * apart**low + share * apart ** (low + 1))
        total += math.comb(POSITIONS, agree) * threshold**agree * (1 - threshold) ** (POSITIONS - agree) * (1 - p) ** runs
    return total


def runs_needed(threshold: float, levels: int, recall: float) -> int:
    """Runs until a pair at the threshold is found with probability recall; what no number of runs can find doesn't count."""
    runs = 1
    while miss(threshold, levels, runs) > 1 - recall and runs < 256:
        runs += 1
    return runs


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """Children (bucket, id) of rows (bucket, id, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = np.frombuffer(b"".join(b["sketch"]), np.uint32).reshape(-1, POSITIONS)
            bucket, ids = b["bucket"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
            row, place = sampled(bucket, threshold)
            child = mix(mix(bucket[row].view(np.uint64) + np.uint64(1) + place.astype(np.uint64)) ^ tokens[row, place].astype(np.uint64))
            yield pd.DataFrame({"bucket": child.view(np.int64), "id": ids[row]})

    return rows.select("bucket", "id", "sketch").mapInPandas(run, "bucket long, id long")


def leaves(sets: DataFrame, threshold: float, small: int, levels: int, recall: float) -> DataFrame:
    """bucket, id and n (sets in the bucket) of all final buckets of two sets or more."""
    seeds = [int(x) for x in mix(np.arange(1, runs_needed(threshold, levels, recall) + 1, dtype=np.uint64)).view(np.int64)]
    rows, done = sets.select(F.explode(F.array(*map(F.lit, seeds))).alias("bucket"), "id", "sketch"), None
    for level in range(levels):
        children = cut(split(rows, threshold))
        sizes = cut(children.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))  # a table, so that the join can split a large bucket
        sized = cut(children.join(sizes, "bucket"))
        drop(children, sizes)
        final = sized if level == levels - 1 else sized.where(F.col("n") <= small)
        done = final if done is None else done.unionByName(final)
        large = sized.where(F.col("n") > small)
        if level == levels - 1 or large.isEmpty():
            return done
        rows = large.join(sets.select("id", "sketch"), "id")
    return done


def useful(final: DataFrame) -> DataFrame:
    """Rows of leaves() with rank (the bucket's place, larger buckets first) and home (the set's least rank), without buckets that
    no pair counts in, as their sets have one home elsewhere; and paths, all ranks of each set."""
    rank = F.shiftleft(F.lit((1 << 22) - 1) - F.least("n", F.lit((1 << 22) - 1)), 40).bitwiseOR(F.shiftrightunsigned("bucket", 24))
    ranked = cut(final.select(rank.alias("rank"), "id", "n"))
    paths = cut(ranked.groupBy("id").agg(F.array_sort(F.collect_set("rank")).alias("paths")))  # runs and their paths, however many sets
    homes = cut(ranked.join(paths.select("id", F.col("paths")[0].alias("home")), "id"))
    told = homes.groupBy("rank").agg(F.min("home").alias("low"), F.max("home").alias("high"))
    kept = cut(told.where((F.col("low") != F.col("high")) | (F.col("low") == F.col("rank"))).select("rank"))
    out = cut(homes.join(kept, "rank").join(paths, "id"))
    drop(ranked, paths, homes, kept)
    return out


def cells(rows: DataFrame) -> DataFrame:
    """Rows of buckets (rank, id, size) with their cell: the bucket, or for a large one each two of its blocks; side: 0 or 1, 2 where both blocks are one."""
    blocks = rows.groupBy("rank").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(cut(blocks), "rank")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "rank"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("rank", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("cell", cell).withColumn("side", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("int")).drop("own", "other", "blocks")


def whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, sorted by cell, so that no cell is in two frames."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b["cell"].to_numpy() == b["cell"].iloc[-1]
        rest = b[last]
        if not last.all():
            yield b[~last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def candidate_pairs(b: pd.DataFrame, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one cell whose sketches agree in `least` positions, and whose largest common bucket is the cell's own."""
    cell, side = b["cell"].to_numpy(np.int64), b["side"].to_numpy()
    tokens = np.frombuffer(b"".join(b["sketch"]), np.uint32).reshape(-1, POSITIONS)
    rank, home, ids = b["rank"].to_numpy(np.int64), b["home"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
    away = home != rank
    counts = b["paths"].map(len).to_numpy()
    paths = np.full((len(b), counts.max(initial=1)), np.iinfo(np.int64).max)
    paths[np.arange(paths.shape[1]) < counts[:, None]] = np.concatenate([*b["paths"], np.zeros(0, np.int64)])
    last = np.searchsorted(cell, cell, "right")
    gap, left = 1, np.flatnonzero(last - np.arange(len(cell)) > 1)
    while len(left):
        i, j = left, left + gap
        ok = ((side[i] == 2) | (side[i] != side[j])) & (ids[i] != ids[j]) & ~(away[i] & (home[i] == home[j]))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            near = np.flatnonzero((tokens[x] == tokens[y]).sum(1) >= least)
            x, y = x[near], y[near]
            own = np.zeros(len(x), bool)
            for m in range(0, len(x), 1 << 12):
                u, v = paths[x[m : m + (1 << 12)]], paths[y[m : m + (1 << 12)]]
                both = (u[:, :, None] == v[:, None, :]).any(2)  # sorted, so the first in common is the smallest
                own[m : m + (1 << 12)] = u[np.arange(len(u)), both.argmax(1)] == rank[x[m : m + (1 << 12)]]
            if own.any():
                yield x[own], y[own]
        gap += 1
        left = left[left + gap < last[left]]


def common_sizes(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements sets i[k] and j[k] have in common."""
    if len(i) <= 4 * len(sets):
        return np.array([_common(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))  # many pairs of few sets: mark one set at a time and add up the marks of its partners
    _, flat = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True)
    size = np.array([len(sets[x]) for x in used])
    begin = np.cumsum(size) - size
    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
    order = np.argsort(i, kind="stable")
    out, mark = np.zeros(len(i), np.int64), np.zeros(int(flat.max()) + 1, bool)
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) > 0, [True]]))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        x, own = i[order[a]], order[a:z]
        mark[flat[begin[x] : begin[x] + size[x]]] = True
        for k in range(0, len(own), 512):
            y = j[own[k : k + 512]]
            n = size[y]
            at = np.arange(n.sum()) + np.repeat(begin[y] - np.cumsum(n) + n, n)
            out[own[k : k + 512]] = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(n) - n)
        mark[flat[begin[x] : begin[x] + size[x]]] = False
    return out


def compared(b: pd.DataFrame, threshold: float, least: int) -> pd.DataFrame:
    """Of whole cells: id, links (documents it is similar to), and a link to another set, or none, that joins what is linked."""
    ids, weight = b["id"].to_numpy(np.int64), b["n_docs"].to_numpy(np.int64)
    sets = [np.frombuffer(s, np.uint64) for s in b["set"]]
    size = np.array([len(s) for s in sets])
    links, parent = np.zeros(len(b), np.int64), np.arange(len(b))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = list(candidate_pairs(b, least))
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        common = common_sizes(sets, i, j)
        hit = common >= threshold * (size[i] + size[j] - common) - 1e-9
        i, j = i[hit], j[hit]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some], "to": ids[[root(i) for i in some.tolist()]] if len(some) else np.zeros(0, np.int64)})


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def classes(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id and label (smallest id joined to it) from edges a, b between different ids."""
    edges = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("other"))
        told = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(told.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        drop(labels)
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            drop(edges)
            return labels
    raise RuntimeError("classes did not settle")


def members(df: DataFrame, threshold: float = 0.8, shingle: int = 5, small: int = 64, levels: int = 3, recall: float = 0.99999) -> DataFrame:
    """id (of the set), label (of its class), doc_id, hash (of the text), class_id and n_links of each row."""
    least = math.floor(POSITIONS * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / POSITIONS)))
    rows = cut(documents(df, shingle))
    full = rows.where("id <> 0")
    sets = cut(full.groupBy("id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("least_doc"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    final = leaves(sets, threshold, small, levels, recall)
    kept = useful(final)
    drop(final)
    columns = ["cell", "side", "rank", "home", "id", "n_docs", "least_doc", "sketch", "paths"]
    slim = cells(kept.join(sets, "id")).select(columns)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_cells(batches):
            use = np.zeros(len(b), bool)
            for i, j in candidate_pairs(b, least):
                use[i] = use[j] = True
            yield b.loc[use, columns]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_cells(batches):
            yield compared(b, threshold, least)

    kind = df.schema["doc_id"].dataType.simpleString()
    form = f"cell long, side int, rank long, home long, id long, n_docs long, least_doc {kind}, sketch binary, paths array<long>"
    near = cut(slim.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(wanted, form))
    drop(kept)
    keys = near.select(F.col("least_doc").alias("key")).distinct()
    texts = df.select("doc_id", "text").join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")  # by shuffle at every size

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, _, key, at in shingles(list(b["text"]), shingle):
                yield pd.DataFrame({"id": set_id(key, at), "set": [key[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]})

    sets_again = texts.select("text").mapInPandas(filled, "id long, set binary").dropDuplicates(["id"])
    compare = near.join(sets_again, "id").repartition(parts, "cell").sortWithinPartitions("cell")
    found = cut(compare.mapInPandas(linked, "id long, links long, to long"))
    drop(near)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = classes(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    heads = joined.join(sets.select("id", "least_doc"), "id").groupBy("label").agg(F.min("least_doc").alias("class_id"))
    result = sets.select("id", "n_docs", "least_doc").join(links, "id", "left").join(joined, "id", "left").join(heads, "label", "left")
    result = result.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("class_id", "least_doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    out = rows.select("id", "doc_id", "hash").join(cut(result), "id", "left")  # a table, so that the join can split a set with many copies
    return out.select("id", "label", "doc_id", "hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(df: DataFrame, threshold: float = 0.8, shingle: int = 5, small: int = 64, levels: int = 3, recall: float = 0.99999) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class) and n_links (other documents it is similar to) of each row."""
    return members(df, threshold, shingle, small, levels, recall).select("doc_id", "class_id", "n_links")


def one_of_each(df: DataFrame, **how) -> DataFrame:
    """df with one row of each class: of its least doc_id (null last), then of the least text hash; of rows equal in both the one with
    the least hash of its other columns. Rows without words stay."""
    own, key = F.md5(F.col("text").cast("binary")), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    found = members(df, **how).where("id <> 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("h")).select(F.col("h.doc_id").alias("doc_id"), F.col("h.hash").alias("_hash"))
    heads = found.select(key.alias("_key"), "_hash")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c not in ("doc_id", "text")))
    rows = df.where(worded).groupBy(key.alias("_key"), own.alias("_hash")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.md5(F.to_json(rest).cast("binary"))).alias("_row"))
    return rows.join(heads, ["_key", "_hash"]).select("_row.*").unionByName(df.where(~worded))
