import hashlib
import math
import random

import numpy as np
import pytest

from binfields.llm.clustering import Pivots, _exact, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, id double, v int, p string"


def brute(rows, k, rounds, dims, scale=256):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for _, n, _ in found}
    return [(i, n, d, inertia[n], sum(inertia.values()), tuple(centroids[n])) for i, n, d in found]


def check(spark, rows, k, dims, rounds=5, **options):
    df = spark.createDataFrame([(i, v, "c", 0.5, 1, "p") for i, v in rows], SCHEMA).repartition(3)
    out = cluster_vectors(df, k, dimensions=dims, rounds=rounds, **options)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((*r[:5], tuple(r[5])) for r in out.collect()), key=key) == sorted(brute(rows, k, rounds, dims), key=key)


def test_groups_and_noise(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 4]]) for i in range(150)] + [(1000 + i, [rng.uniform(-3, 3) for _ in range(6)]) for i in range(60)]
    check(spark, [(i, [float(np.float32(x)) for x in v]) for i, v in rows], 9, 6)


def test_ties_copies_and_negative_sums(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(3)]) for i in range(120)] + [(500 + i, [-1 / 256, 0.0, 2 / 256]) for i in range(80)] + [(3, [0.0, 0.0, 0.0])] * 3
    check(spark, rows, 12, 3)
    check(spark, rows, 12, 3, pivots=2)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, nan]), (15, [inf, 0.0]), (20, [None, 1.0]), (None, [1.0, 1.0]), (25, [3.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [1.0, 2.0, 3.0]), (6, [])]
    check(spark, rows, 10, 2)
    check(spark, rows, 2, 2)
    check(spark, [(1, [1.0, 1.0])] * 7, 3, 2)
    check(spark, [], 3, 2)


@pytest.mark.parametrize("spread", [3, 1000, 10**7])
def test_bounds_are_never_above_the_distance(spread):
    rng = np.random.default_rng(spread)
    points, others = rng.integers(-spread, spread, (400, 5)), rng.integers(-spread, spread, (30, 5))
    points[:30] = others
    pivots = Pivots.far_apart(others, 6)
    low = pivots.bounds(pivots.distances(points), pivots.distances(others))
    true = np.stack([_exact(points, o) for o in others], 1)
    assert (low <= true).all()
    assert (low > 0.3 * true).mean() > 0.2
