"""Centroid clustering against a plain version, and its bounds against true distances."""

import hashlib
import math

import numpy as np
import plain as P
import pytest

from eventlens.llm.centroids import cluster_vectors, nearest, simplex_of, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, ints string, apex string"


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance) and the final centroids."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    drawn = [hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in kept]
    first = sorted(range(len(kept)), key=lambda j: (drawn[j], kept[j][1]))[:k]
    centroids = [kept[j][1] for j in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def edge_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + i % 3).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, -0.5, 0.25, 3.0]) for i in range(30)]
    rows += [(7, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, 0.2, 0.3, 0.4]), (None, [0.0, 0.0, 0.0, 0.0]), (200, None), (201, [])]
    rows += [(202, [1.0, 2.0, 3.0]), (203, [1.0, None, 2.0, 3.0]), (204, [math.nan, 0.0, 0.0, 0.0])]
    rows += [(205, [math.inf, 0.0, 0.0, 0.0]), (206, [-300.0, 9000.5, 0.0, -0.0])]
    return [(i, v, None, "x", "y", "z", "a") for i, v in rows]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5, 40, 500])
def test_cluster_vectors(spark, k):
    rows = edge_vectors()
    out, centroids = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k, dims=4)
    want, plain_centroids = plain(rows, k, 5, 4)
    assert got(out) == sorted(want, key=repr)
    assert centroids.tolist() == plain_centroids
    sums = with_inertia(out).select("cluster", "cluster_inertia", "inertia").distinct().collect()
    assert {r[2] for r in sums} == {sum(d for *_, d in want)}
    assert sum(r[1] for r in sums) == sums[0][2]


def test_no_vectors_and_large_ones(spark):
    assert cluster_vectors(spark.createDataFrame([], SCHEMA), dims=4)[0].count() == 0
    large = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(large, dims=2)


@pytest.mark.parametrize("scale", [1, 1000, 10**6])
def test_bounds_hold_and_leave_few(scale):
    rng = np.random.default_rng(1)
    centres = rng.integers(-100, 100, (40, 64)) * scale
    points = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64)) * scale
    points[0] = centres[5]
    simplex = simplex_of(centres)
    a, b = simplex.apexes(simplex.squares(points)), simplex.apexes(simplex.squares(centres))
    true = ((points[:, None] - centres) ** 2).sum(axis=2)
    low = ((a[:, None] - b) ** 2).sum(axis=2)
    high = low + 4 * a[:, None, -1] * b[:, -1]
    assert (low <= true * (1 + 1e-9) + 1e-6).all() and (high >= true * (1 - 1e-9) - 1e-6).all()
    cluster, distance, asked = nearest(points, a.astype(np.float32).astype(float), centres, b)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert asked < 0.5 * true.size


def test_simplex_of_points_on_a_line():
    points = np.array([[0, 0, 0], [1, 1, 1], [5, 5, 5], [5, 5, 5]])
    simplex = simplex_of(points)
    assert len(simplex.pivots) == 2
    assert np.allclose(simplex.apexes(simplex.squares(points))[:, 0], np.sqrt(3) * np.array([0, 1, 5, 5]))
