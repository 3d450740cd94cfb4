"""Rounds over two trees against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from flowlens.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, key string, grid int, cluster string, distance double, at int, points int"
EXTRA = ("k", 1, "c", 0.5, 2, 3)


def plain(rows, k, rounds, size):
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * 256 <= clusters.LIMIT for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                centroids[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    told = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, c in told if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(repr, ((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in told)))


def vectors(seed, n, size, spread=0.01):
    r = np.random.default_rng(seed)
    hubs = r.normal(size=(6, size))
    return [(int(i), (hubs[i % 6] + spread * r.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("size", "spread", "block"), [(4, 0.05, 64), (8, 1.0, 2048), (3, 1e5, 50)])
def test_clusters_equal_plain_rounds(spark, size, spread, block):
    rows = vectors(size, 400, size, spread)
    rows += [rows[7]] * 40 + [(None, rows[3][1]), (1000, None), (1001, [0.5] * (size - 1)), (1002, [math.nan] * size), (1003, [math.inf] * size), (1004, [None] * size), (1005, []), (1006, [1e300] * size), (1007, [-0.0] * size)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, clusters.clustered(df, k=12, rounds=3, size=size, block=block).collect())))
    assert got == plain(rows, 12, 3, size)


def test_few_and_no_vectors(spark):
    few = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-5.0, 1.0])]
    df = spark.createDataFrame([(*r, *EXTRA) for r in few], SCHEMA)
    assert sorted(map(repr, map(tuple, clusters.clustered(df, size=2).collect()))) == plain(few, 40, 5, 2)
    assert clusters.clustered(df.limit(0), size=2).count() == 0


def test_trees_leave_out_most_pairs_of_clustered_vectors():
    points = np.floor(256 * np.array([v for _, v in vectors(5, 2000, 16)])).astype(np.int64)
    tree, order = clusters.cover_tree(np.unique(points, axis=0))
    assert sorted(order.tolist()) == list(range(len(order)))
    for n in range(len(tree.begin)):
        own = tree.points[tree.begin[n] : tree.end[n]]
        assert clusters.squares(own, tree.points[tree.centre[n] : tree.centre[n] + 1]).max() <= tree.radius[n] ** 2 + 1e-6
    hubs, number = clusters.cover_tree(points[:40].copy())
    to, compared = clusters.nearest(tree, hubs, number)
    assert (to == clusters.squares(tree.points, points[:40]).argmin(1)).all()
    assert compared < 0.25 * len(points) * 40
