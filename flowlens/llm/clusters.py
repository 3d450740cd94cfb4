"""Centroid clustering: Lloyd's rounds over two trees.

Vectors are grids of whole numbers, floor(256 * x). A batch of at most BLOCK vectors becomes a cover tree, once: the root's ball
holds the batch, a node's children are centres that cover its points and are more than its radius / BASE apart. Nodes of LEAF points
or less, and those that would need a centre for every four points, as noise of many dimensions does, are leaves. Trees are rows of a
table. Each round makes a tree over the centroids, a task walks both:

- a node pair is left out if its least possible distance is beyond the greatest possible distance of the vector node's points to
  some other centroid, by centres and radii;
- a vector node that one centroid is left for takes it as a whole;
- where both nodes are leaves, all their distances are compared exactly, equal ones by the smaller number.

A task adds up its vectors by centroid, so a round shuffles as many rows as tasks times centroids, and only centroids come to the
driver and go out with the next round: a number of them that the caller sets. Batches are dealt as the table comes, so frequent
vectors are in no group of their own; equal ones within a batch are one point of its tree.

Kept are vectors of the given dimension without nulls, NaN and infinities, whose whole numbers are at most LIMIT in size (beyond, a
squared distance is no long). Repeated rows count as often as they come. Fewer vectors than centroids give fewer centroids. Null
ids are kept, as `2:` in the order of first centroids; ties there are broken by the vector. An empty table gives none. Other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut

BLOCK, LEAF, BASE = 2048, 12, 1.3
LIMIT = 1 << 27
EXACT = 1 << 22  #: up to this size doubles hold all that squared distances are made of


class Tree(NamedTuple):
    """Points in the order of the tree; nodes with their points (begin to end), centre (a point), radius and first to last child."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a and rows of b, as exact int64; components are at most LIMIT in size."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = (d * d).sum(1)
    return out


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over different points, and the points' order in it."""
    order = np.arange(len(points))
    nodes = {"begin": [], "end": [], "centre": [], "radius": [], "first": [], "last": []}

    def add(begin: int, end: int, centre: int) -> int:
        own = order[begin:end]
        far = np.sqrt(squares(points[own], points[centre : centre + 1])[:, 0].max(initial=0))
        for name, value in zip(nodes, (begin, end, centre, float(far), 0, 0), strict=True):
            nodes[name].append(value)
        return len(nodes["begin"]) - 1

    waiting = [add(0, len(points), 0)] if len(points) else []
    while waiting:
        node = waiting.pop()
        begin, end, radius, centre = (nodes[n][node] for n in ("begin", "end", "radius", "centre"))
        if end - begin <= LEAF or radius == 0:
            continue
        own = order[begin:end]
        cover = radius / BASE
        to, left, centres, pick = np.full(len(own), -1), np.arange(len(own)), [], int(np.flatnonzero(own == centre)[0])
        while len(left) and 4 * len(centres) <= len(own):
            near = squares(points[own[left]], points[own[pick] : own[pick] + 1])[:, 0] <= cover * cover
            near |= left == pick
            to[left[near]] = len(centres)
            centres.append(int(own[pick]))
            left = left[~near]
            pick = int(left[0]) if len(left) else -1
        if len(left):
            continue
        by = np.argsort(to, kind="stable")
        order[begin:end] = own[by]
        bounds = begin + np.concatenate([[0], np.cumsum(np.bincount(to))])
        nodes["first"][node] = len(nodes["begin"])
        for c, a, z in zip(centres, bounds[:-1], bounds[1:], strict=True):
            waiting.append(add(int(a), int(z), c))
        nodes["last"][node] = len(nodes["begin"])
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    arrays = {n: np.array(v, float if n == "radius" else np.int64) for n, v in nodes.items()}
    arrays["centre"] = place[arrays["centre"]]
    return Tree(points[order], **arrays), order


def nearest(vectors: Tree, centroids: Tree, number: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point of `vectors` (of equal ones that with the smaller number; number: of each point of
    `centroids`), and how many distances of points were compared."""
    out, compared = np.zeros(len(vectors.points), np.int64), 0
    spots = vectors.points[vectors.centre]
    hubs = centroids.points[centroids.centre]
    waiting = [(0, np.zeros(1, np.int64))]
    while waiting:
        node, near = waiting.pop()
        reach = vectors.radius[node]
        while True:
            middle = np.sqrt(squares(spots[node : node + 1], hubs[near])[0])
            slack = 1e-9 * (1 + middle + reach)
            near = near[middle - reach - centroids.radius[near] - slack <= (middle + reach + slack).min()]
            open_ = (centroids.last[near] > centroids.first[near]) & (centroids.radius[near] >= reach)
            if not open_.any():
                break
            near = np.concatenate([near[~open_], *(np.arange(centroids.first[x], centroids.last[x]) for x in near[open_])])
        begin, end = vectors.begin[node], vectors.end[node]
        if len(near) == 1 and centroids.end[near[0]] - centroids.begin[near[0]] == 1:
            out[begin:end] = number[centroids.begin[near[0]]]
        elif vectors.last[node] > vectors.first[node]:
            waiting += [(child, near) for child in range(vectors.first[node], vectors.last[node])]
        else:
            some = np.concatenate([np.arange(centroids.begin[x], centroids.end[x]) for x in near])
            some = some[np.argsort(number[some])]
            out[begin:end] = number[some][squares(vectors.points[begin:end], centroids.points[some]).argmin(1)]
            compared += int(end - begin) * len(some)
    return out, compared


FIELDS = {"points": np.int64, "begin": np.int64, "end": np.int64, "centre": np.int64, "radius": float, "first": np.int64, "last": np.int64, "at": np.int64}


def planted(vectors: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """A row for each batch of vectors (key, grid): its keys, their places (at) in its tree, and the tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), block):
                own = b.iloc[k : k + block]
                points, at = np.unique(np.array(own["grid"].tolist(), np.int64).reshape(-1, size), axis=0, return_inverse=True)
                tree, order = cover_tree(points)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                fields = tree._asdict() | {"at": place[at.ravel()]}
                yield pd.DataFrame([{"keys": own["key"].tolist()} | {n: fields[n].astype(t).tobytes() for n, t in FIELDS.items()}])

    return vectors.select("key", "grid").mapInPandas(run, "keys array<string>, " + ", ".join(f"{n} binary" for n in FIELDS))


def _read(row, size: int) -> tuple[Tree, np.ndarray]:
    fields = {n: np.frombuffer(getattr(row, n), t) for n, t in FIELDS.items()}
    at = fields.pop("at")
    fields["points"] = fields["points"].reshape(-1, size)
    return Tree(**fields), at


def sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim (-1: of the number of vectors) and total of vectors by their nearest centroid."""
    k, size = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hubs, number = cover_tree(centroids)
        total = np.zeros((k, size + 1), np.int64)
        for b in batches:
            for row in b.itertuples(index=False):
                tree, at = _read(row, size)
                to, n = nearest(tree, hubs, number)[0], np.bincount(at, minlength=len(tree.points))
                for c in np.unique(to):
                    own = to == c
                    total[c, :size] += (tree.points[own] * n[own, None]).sum(0)
                    total[c, size] += n[own].sum()
        used = np.flatnonzero(total[:, size])
        yield pd.DataFrame({"cluster": np.repeat(used, size + 1), "dim": np.tile([*range(size), -1], len(used)), "total": total[used].ravel()})

    return trees.mapInPandas(run, "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster and distance (squared) of each vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hubs, number = cover_tree(centroids)
        for b in batches:
            for row in b.itertuples(index=False):
                tree, at = _read(row, size)
                to = nearest(tree, hubs, number)[0]
                away = tree.points - centroids[to]
                yield pd.DataFrame({"key": row.keys, "cluster": to[at].astype(np.int32), "distance": (away * away).sum(1)[at]})

    return trees.mapInPandas(run, "key string, cluster int, distance long")


def grids(df: DataFrame, column: str, size: int) -> DataFrame:
    """df with grid, the whole numbers of kept vectors."""
    whole = F.transform(F.col(column), lambda x: F.floor(256 * x.cast("double")))
    fine = (F.size(column) == size) & F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= LIMIT / 256), F.lit(False)))
    return df.where(F.coalesce(fine, F.lit(False))).withColumn("grid", whole)


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors (key, grid) with the least SHA-256 of `2:key`."""
    by = F.sha2(F.concat(F.lit("2:"), F.coalesce("key", F.lit(""))).cast("binary"), 256)
    return np.array([r["grid"] for r in vectors.orderBy(by, "grid").limit(k).select("grid").collect()], np.int64)


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector after `rounds` rounds."""
    spark, kind = df.sparkSession, df.schema[key].dataType
    vectors = grids(df, column, size).select(F.col(key).cast("string").alias("key"), "grid")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)
    trees = cut(planted(vectors, size, block))
    for _ in range(rounds):
        total: dict[int, dict[int, int]] = {}
        for r in sums(trees, centroids).collect():  # k * (size + 1) numbers
            total.setdefault(r["cluster"], {})[r["dim"]] = r["total"]
        for c, own in total.items():
            centroids[c] = [own[d] // own[-1] for d in range(size)]
    last = cut(assigned(trees, centroids))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = {r["cluster"]: r["cluster_inertia"] for r in by.collect()}  # k numbers
    rows = [(c, told[c], sum(told.values()), digest[c]) for c in told] or [(0, 0, 0, "")]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select(F.col("key").cast(kind).alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assign(n: int, k: int) -> str:
    return (
        f"d{n} AS (SELECT vec_id, row, g, c, cg, list_sum(list_transform(list_zip(g, cg), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n}), "
        f"a{n} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(g) AS g, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{n} GROUP BY row)"
    )


def oracle_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """The same by comparing each vector with each centroid."""
    steps = [
        f"v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS g FROM embeddings "
        f"WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, g) - 1 AS INTEGER) AS c, g AS cg FROM (SELECT g, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) ORDER BY h, g LIMIT {k})",
    ]
    for n in range(rounds):
        low = "CAST(t - ((t % n) + n) % n AS BIGINT)"
        steps += [
            _assign(n, k),
            f"p{n} AS (SELECT c, i, sum(g[i]) AS t, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY c, i)",
            f"m{n} AS (SELECT c, list({low} // n ORDER BY i) AS cg FROM p{n} GROUP BY c)",
            f"c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.cg, c{n}.cg) AS cg FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)",
        ]
    steps.append(_assign(rounds, k))
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(cg, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (c)"
    )
