"""Centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from rowwarden.llm import centroids
from tests.llm.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, size, scale, seed):
    kept = [(n, [math.floor(scale * float(np.float32(x))) for x in v]) for n, v, *_ in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(means))
    for _ in range(rounds):
        members = [near(v)[1] for _, v in kept]
        for n in set(members):
            own = [v for (_, v), m in zip(kept, members, strict=True) if m == n]
            means[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(n, *near(v)) for n, v in kept]
    inertia = {c: sum(d for _, d, x in found if x == c) for _, _, c in found}
    digest = lambda c: hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()
    return sorted(((n, c, d, inertia[c], sum(inertia.values()), digest(c)) for n, d, c in found), key=repr)


def some_rows(n, size, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(4)]
    return [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)], 0) for k in range(n)]


@pytest.mark.parametrize(("k", "rounds"), [(6, 3), (1, 2), (200, 2), (5, 0)])
def test_clusters_equal_plain(spark, k, rounds):
    rows = some_rows(120, 8)
    rows += [(3, rows[3][1], 0)] * 60 + [(500 + n, [0.5] * 8, 0) for n in range(5)]  # repeated rows and ties
    rows += [(900, None, 0), (901, [1.0] * 7, 0), (902, [1.0] * 9, 0), (903, [float("nan")] * 8, 0), (904, [1.0, None] * 4, 0),
             (905, [float("inf")] + [0.0] * 7, 0), (None, [0.25] * 8, 0)]
    found = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=k, rounds=rounds, components=8)
    assert rows_of(found) == plain(rows, k, rounds, 8, 256, 2)


def test_empty_clashing_and_huge(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(empty).collect() == []
    assert centroids.cluster(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = some_rows(20, 64)
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as r", "3 as cluster", "4 as distance", "5 as n", "6 as key")
    assert rows_of(centroids.cluster(extra)) == plain(rows, 40, 5, 64, 256, 2)
    with pytest.raises(Exception, match="scaled component"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()
    same = [(n, [-0.1] * 64, 0) for n in range(50)]
    assert rows_of(centroids.cluster(spark.createDataFrame(same, SCHEMA))) == plain(same, 40, 5, 64, 256, 2)


def test_bounds_leave_out_and_lose_nothing():
    rng = np.random.default_rng(0)
    middles = rng.integers(-2000, 2000, (30, 16))
    x = (middles[rng.integers(0, 30, 5000)] + rng.integers(-60, 60, (5000, 16))).astype(np.int64)
    means = x[:30].copy()
    means[7] = means[3]  # a tie: the smaller number
    centred = x - x.mean(0)
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    for leading in (1, 5, 16):
        cluster, distance, computed = centroids.nearest(
            x, centroids.rotated(x, axes, leading), means, centroids.rotated(means, axes, leading))
        whole = ((x[:, None] - means[None]) ** 2).sum(2)
        assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()
        assert leading == 1 or computed < len(x) * 6
