"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for c in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i if i is not None else -1, n, d) for i, v in kept for d, n in [nearest(v)]), centroids


def rows(n=300, dims=8, seed=5):
    draw = random.Random(seed)
    out = [(i, [draw.randint(-6, 6) / 4 for _ in range(dims)]) for i in range(n)]
    out += out[:20]
    return [*out, (None, out[3][1]), (1000, None), (1001, [None] * dims), (1002, [float("nan")] * dims), (1003, [float("inf")] + [0.0] * (dims - 1)), (1004, [1.0]), (1005, [])]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_rounds_equal_a_plain_version(spark, k):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(5)
    found, centroids = clustering.cluster(df, k=k, dims=8, scale=4)
    want, final = plain(data, k, 3, 8, 4)
    assert centroids == final
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in found.collect()) == want


def test_search_is_exact_on_ties_and_skips_centroids():
    draw = np.random.default_rng(7)
    for k in (1, 2, 17, 60):
        c, x = draw.integers(-3, 4, (k, 3)), draw.integers(-3, 4, (500, 3))
        best, dist, _ = clustering.Orchard(c).nearest(x)
        every = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (dist == every.min(1)).all()
    centres = draw.integers(-1000, 1000, (64, 8))
    x = np.repeat(centres, 30, axis=0) + draw.integers(-5, 6, (64 * 30, 8))
    assert clustering.Orchard(centres).nearest(x)[2] < 0.5 * len(x) * len(centres)


def test_fewer_vectors_than_centroids_and_none(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0], "a", 0), (2, [1.0, 2.0], "a", 0)], SCHEMA)
    found, centroids = clustering.cluster(some, k=16, dims=2)
    assert len(centroids) == 2 and sorted(map(tuple, found.collect())) == [(1, 0, 0), (2, 0, 0)]
    none, centroids = clustering.cluster(some.where("vec_id > 5"), dims=2)
    assert centroids == [] and none.count() == 0
    assert clustering.with_inertia(none, []).count() == 0


def test_components_too_large_stop_the_job(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1e300, 0.0], "a", 0)], SCHEMA), dims=2)
