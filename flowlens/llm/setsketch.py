"""MinHash near-dedup by SetSketch.

A document is its set of shingles, runs of `shingle` words with A-Z in lower case (all its words if it has fewer). A register of a
set's sketch is floor(1 - log_b h), cut to 0 to TOP, for the least h of exponential hashes of its shingles: exponentially spaced
truncated minima. Registers merge by their maximum, and sets agree in a register with a probability of log_b(1 + J(b - 1)) or more at
Jaccard similarity J.

Sets that agree in all registers of one of BANDS bands meet in a bucket. How many registers are greater, equal and less in one of two
sets of known sizes tells a likelihood for each J; a pair goes on unless no J of the threshold or more comes near (NEAR) the most
likely one. What goes on is compared by all its shingles. A pair at the threshold meets in no bucket with a chance of 5e-7.

What is asked for are components, so no bucket is compared pair by pair at once. First each set is compared with the set of each
of its buckets that shares most with others (its pivot), which joins groups of near copies with one comparison for each member.
Then only buckets that still hold several components are taken up, and only pairs across components, whatever their number: small
buckets whole, others in blocks of BLOCK, where sets of the bucket's largest component meet those outside it but not each other. A
task gives a forest of links, never pairs. Forests become components by smallest-label propagation over tables.

Null and empty texts have no shingles, are linked with nothing, and stand for themselves. Documents with equal sets are one set.
Repeated rows give repeated rows; component_id is the least doc_id, null only where all are. Sets are told apart by a 63-bit hash of
all shingles, texts of any length are taken whole, ids may be of any type that has an order. An empty table gives none. Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut, drop
from flowlens.llm.jaccard import classes, set_id, shingles, whole_cells

REGISTERS, BASE, RATE, TOP = 256, 1.2, 20.0, 254
BAND, BANDS = 6, 42
BLOCK = 256
NEAR = 12.5  #: of log-likelihood, five standard errors
FEWEST = 150  #: registers that agree; at the threshold fewer than nine standard errors below what is expected
_FACTOR = np.random.Generator(np.random.PCG64(15)).integers(1, 1 << 62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.random.Generator(np.random.PCG64(16)).integers(1, 1 << 62, REGISTERS, dtype=np.uint64)


def sketches(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (n, REGISTERS) of sets with bounds `at` in `key`; of empty sets zeros."""
    out = np.zeros((len(at) - 1, REGISTERS), np.uint8)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for j in range(REGISTERS):
            low = np.minimum.reduceat(key * _FACTOR[j] + _SHIFT[j], at[full])  # uniform, so -log(1 - low) / RATE is exponential
            h = -np.log1p(-(low.astype(float) + 0.5) / 2.0**64) / RATE
            out[full, j] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP)
    return out


def likely(greater: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of sizes a and b, whose registers are so often greater and less, may have a Jaccard similarity of threshold or more."""
    u, v = a / (a + b), b / (a + b)
    most = np.minimum(a, b) / np.maximum(a, b)
    equal = REGISTERS - greater - less

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = (np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1) for x in (u - v * j, v - u * j))
        return greater * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    at = np.minimum(threshold, most)
    below = np.max([fit(at * x) for x in np.linspace(0, 1, 17)], axis=0)
    above = np.max([fit(at + (most - at) * x) for x in np.linspace(0, 1, 6)], axis=0)
    return (most >= threshold - 1e-12) & (above >= np.maximum(below, above) - NEAR)


def documents(df: DataFrame, shingle: int) -> DataFrame:
    """id (of the set; 0: none), doc_id, size (of the set) and sketch of each row."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n, key, at in shingles(list(b["text"]), shingle):
                yield pd.DataFrame({"id": set_id(key, at), "doc_id": b["doc_id"].iloc[first : first + n].to_numpy(), "size": np.diff(at), "sketch": [r.tobytes() for r in sketches(key, at)]})

    key = F.col("doc_id").cast("string")  # pandas has no whole numbers beside nulls
    told = df.select(key.alias("doc_id"), "text").mapInPandas(run, "id long, doc_id string, size long, sketch binary")
    return told.withColumn("doc_id", F.col("doc_id").cast(kind))


def lowered(df: DataFrame) -> DataFrame:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.select("doc_id", F.translate("text", letters, letters.lower()).alias("text"))


def pairs_of(b: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one cell on sides that meet, of different labels, whose registers allow the threshold, and whose first band in
    common is the cell's (band; -1: any). Rows are sorted by cell."""
    cell, side, label, size, band = (b[c].to_numpy() for c in ("cell", "side", "label", "size", "band"))
    registers = np.frombuffer(b"".join(b["sketch"]), np.uint8).reshape(-1, REGISTERS)
    last = np.searchsorted(cell, cell, "right")
    found, gap, left = [], 1, np.flatnonzero(last - np.arange(len(cell)) > 1)
    while len(left):
        ok = ((side[left] == 2) | (side[left] != side[left + gap])) & (label[left] != label[left + gap])
        for k in range(0, int(ok.sum()), 1 << 14):
            i = left[ok][k : k + (1 << 14)]
            same = registers[i] == registers[i + gap]
            lanes = same.view(np.uint64).sum(1)  # eight counts of up to 32 in the bytes of each
            use = np.flatnonzero(lanes.view(np.uint8).reshape(-1, 8).sum(1, dtype=np.uint16) >= FEWEST)
            met = same[use, : BAND * BANDS].reshape(-1, BANDS, BAND).all(2)
            use = use[(band[i[use]] < 0) | (met.argmax(1) == band[i[use]])]
            i = i[use]
            if len(i):
                x, y = registers[i], registers[i + gap]
                found.append((i, i + gap, np.count_nonzero(x > y, axis=1), np.count_nonzero(x < y, axis=1)))
        gap += 1
        left = left[left + gap < last[left]]
    i, j, greater, less = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(4))
    use = [likely(greater[k : k + (1 << 16)], less[k : k + (1 << 16)], size[i[k : k + (1 << 16)]].astype(float), size[j[k : k + (1 << 16)]].astype(float), threshold) for k in range(0, len(i), 1 << 16)]
    use = np.concatenate(use or [np.zeros(0, bool)])
    return i[use], j[use]


def links(b: pd.DataFrame, threshold: float, shingle: int) -> pd.DataFrame:
    """Of whole cells with texts: links (a, b) between sets that join the labels joined by links there."""
    i, j = pairs_of(b, threshold)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    used, out = np.unique(np.concatenate([i, j])), []
    place = {int(x): n for n, x in enumerate(used)}
    sets: list[np.ndarray] = []
    for _, _, key, at in shingles([b["text"].iloc[x] for x in used], shingle):
        sets += [key[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]
    ids = b["id"].to_numpy()
    names, labels = np.unique(b["label"].to_numpy(), return_inverse=True)  # one cell's label may be another's, and stand for the same sets

    def apart(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """The pairs, without those that are joined by the time their turn comes near."""
        for k in range(0, len(i), 1 << 12):
            roots = np.arange(len(names))
            for x in list(parent):
                roots[x] = root(x)
            some = roots[labels[i[k : k + (1 << 12)]]] != roots[labels[j[k : k + (1 << 12)]]]
            yield from zip(i[k : k + (1 << 12)][some].tolist(), j[k : k + (1 << 12)][some].tolist(), strict=True)

    for x, y in apart(i, j):
        p, q = root(int(labels[x])), root(int(labels[y]))
        if p == q:
            continue
        m, n = sets[place[x]], sets[place[y]]
        at = np.minimum(np.searchsorted(n, m), len(n) - 1)
        both = int((n[at] == m).sum())
        if both >= threshold * (len(m) + len(n) - both) - 1e-9:
            parent[p] = q
            out.append((int(ids[x]), int(ids[y])))
    return pd.DataFrame(out, columns=["a", "b"])


def compared(cells: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Links of cells (cell, side, id, label): rows whose registers match another's get their texts."""
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_cells(batches):
            use = np.zeros(len(b), bool)
            for side in pairs_of(b, threshold):
                use[side] = True
            yield b[use]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_cells(batches):
            yield links(b, threshold, shingle)

    form = "cell long, side int, band int, id long, label long, size long, sketch binary"
    names = [c.split()[0] for c in form.split(", ")]
    dealt = cells.join(sets.select("id", "size", "sketch"), "id").select(names).repartition(parts, "cell").sortWithinPartitions("cell")
    near = cut(dealt.mapInPandas(wanted, form))
    full = near.join(texts, "id").select(*names, "text").repartition(parts, "cell").sortWithinPartitions("cell")
    out = cut(full.mapInPandas(linked, "a long, b long"))
    drop(near)
    return out


def stars(shared: DataFrame) -> DataFrame:
    """Cells of each set with the pivots of its buckets (bucket, id, n): the set of a bucket whose buckets are largest in all."""
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    best = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id"))["id"].alias("pivot"))
    pairs = cut(shared.join(cut(best), "bucket").where("id <> pivot").select("pivot", "id").distinct())
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = pairs.join(cut(sizes), "pivot").withColumn("cell", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), "blocks")))
    hubs = member.select("cell", F.col("pivot").alias("id")).distinct()
    cells = hubs.withColumn("side", F.lit(0)).unionByName(member.select("cell", "id", F.lit(1).alias("side")))
    return cells.withColumns({"label": F.col("id"), "band": F.lit(-1)})


def across(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of buckets with several labels, so that all sets of different labels meet."""
    told = cut(shared.select("bucket", "band", "id").join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label")))
    mixed = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rows = cut(told.join(cut(mixed), "bucket"))
    most = rows.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top"))
    most = most.select("bucket", "all", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("inner"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("outer"))
    rows = rows.join(cut(most), "bucket")
    small, inside = F.col("all") <= BLOCK, F.col("label") == F.col("top")
    own = F.pmod(F.xxhash64("id", "bucket"), F.when(inside, F.col("inner")).otherwise(F.col("outer")))
    to = lambda last: F.sequence(F.lit(0).cast("long"), last - 1)
    met = lambda o: F.struct(F.xxhash64("bucket", F.lit(1), own, o).alias("cell"), F.lit(0).alias("side"))
    side = lambda o: F.when(own == o, 2).otherwise((own > o).cast("int")).cast("int")
    beside = lambda o: F.struct(F.xxhash64("bucket", F.lit(2), F.least(own, o), F.greatest(own, o)).alias("cell"), side(o).alias("side"))
    large = F.when(inside, F.transform(to(F.col("outer")), lambda o: F.struct(F.xxhash64("bucket", F.lit(1), o, own).alias("cell"), F.lit(1).alias("side"))))
    large = large.otherwise(F.concat(F.transform(to(F.col("inner")), met), F.transform(to(F.col("outer")), beside)))
    cells = F.when(small, F.array(F.struct(F.xxhash64("bucket", F.lit(0)).alias("cell"), F.lit(2).alias("side")))).otherwise(large)
    return rows.select("id", "label", "band", F.explode(cells).alias("c")).select("c.cell", "c.side", "band", "id", "label")


def components(df: DataFrame, threshold: float = 0.8, shingle: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (that is its own) of each row."""
    df = lowered(df)
    rows = cut(documents(df, shingle))
    sets = cut(rows.where("id <> 0").groupBy("id").agg(F.min("doc_id").alias("least_doc"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    banded = sets.select("id", F.substring("sketch", 1, BAND * BANDS).alias("sketch"), F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    banded = banded.select("id", "band", F.xxhash64("band", F.substring("sketch", F.col("band") * BAND + 1, F.lit(BAND))).alias("bucket"))
    sizes = cut(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))  # a table, so that the join can split a large bucket
    shared = cut(banded.join(sizes, "bucket"))
    keys = shared.select("id").distinct().join(sets.select("id", "least_doc"), "id").select(F.col("least_doc").alias("key")).distinct()
    own = df.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")  # by shuffle at every size

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n, key, at in shingles(list(b["text"]), shingle):
                yield pd.DataFrame({"id": set_id(key, at), "text": b["text"].iloc[first : first + n].to_numpy()})

    texts = cut(own.select("text").mapInPandas(named, "id long, text string").where("id <> 0").dropDuplicates(["id"]))
    first = compared(stars(shared), sets, texts, threshold, shingle)
    labels = classes(first)
    second = compared(across(shared, labels), sets, texts, threshold, shingle)
    if not second.isEmpty():
        ends = second.join(labels.withColumnRenamed("id", "a"), "a", "left").withColumnRenamed("label", "la").join(labels.withColumnRenamed("id", "b"), "b", "left")
        further = classes(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("label", "b").alias("b")))  # between components
        joined = labels.join(further.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left").select("id", F.coalesce("_to", "label").alias("label"))
        labels = cut(joined.unionByName(further.join(labels.select("id"), "id", "left_anti")))
    heads = labels.join(sets.select("id", "least_doc"), "id").groupBy("label").agg(F.min("least_doc").alias("component_id"))
    told = cut(sets.select("id", "least_doc").join(labels, "id", "left").join(heads, "label", "left").select("id", F.coalesce("component_id", "least_doc").alias("component_id")))
    out = rows.select("id", "doc_id", "size").join(told, "id", "left")  # a table, so that the join can split a set with many copies
    drop(sizes, shared, texts, first, second)
    component = F.when(F.col("id") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: The same by a join on the rarest shingles of each set, two of which every linked pair shares one of, and by reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT row, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
u AS (SELECT s, row_number() OVER () AS id, min(doc_id) AS low, len(s) AS n FROM x WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, unnest(s) AS k FROM u),
f AS (SELECT k, count(*) AS c FROM t GROUP BY k),
p AS (SELECT id, n, k FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY c, k) AS r FROM t JOIN f USING (k)) WHERE r <= n - (8 * n + 9) // 10 + 1),
near AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.k = b.k AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM near JOIN t x ON x.id = a JOIN t y ON y.id = b AND y.k = x.k GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
pairs AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT id, low FROM u UNION SELECT b, low FROM reach JOIN pairs ON pairs.a = reach.id),
c AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(x.s) AS n_shingles, CASE WHEN len(x.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(x.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM x LEFT JOIN u ON u.s = x.s LEFT JOIN c ON c.id = u.id
"""
