import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from binfields.operators import interface, neighbors
from binfields.operators.grid import CELL


def frame(spark, cells):
    return spark.createDataFrame(sorted(cells), "x_bin int, y_bin int").repartition(3)


def nearest(cells, k):
    out = {}
    for x, y in cells:
        gaps = sorted(((a - x) ** 2 + (b - y) ** 2, a, b) for a, b in cells if (a, b) != (x, y))
        out |= {(x, y, r): (a, b, d) for r, (d, a, b) in enumerate(gaps[:k], 1)}
    return out


def found(rows):
    return {(r.x_bin, r.y_bin, r["rank"]): (r.nx, r.ny, r.d2) for r in rows.collect()}


def test_nearest_cells_dense_sparse_and_far(spark):
    rng = random.Random(1)
    dense = {(x, y) for x in range(-6, 6) for y in range(4)}
    sparse = {(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(60)}
    far = {(1_000_000, 0), (1_000_003, -2), (-30_000, 1_000_000)}
    cells = dense | sparse | far
    begin = time.time()
    assert found(neighbors.knn_join(frame(spark, cells), 8)) == nearest(cells, 8)
    assert time.time() - begin < 60


def test_nearest_cells_of_few(spark):
    for cells in ({(0, 0), (1_000_000, 5), (-7, 1_000_000)}, {(3, 4)}, set(), {(0, 0), (0, 1)}):
        assert found(neighbors.knn_join(frame(spark, cells), 2)) == nearest(cells, 2)


def test_nearest_cells_on_a_circle(spark):
    """All of a ring is as near to the cell in its middle."""
    ring = {(round(200 * math.cos(a / 40)), round(200 * math.sin(a / 40))) for a in range(252)} | {(0, 0)}
    assert found(neighbors.knn_join(frame(spark, ring), 5)) == nearest(ring, 5)


def test_nearest_boundary_over_tiles_and_far_away(spark):
    rng = random.Random(2)
    cells = {(rng.randint(-90, 90), rng.randint(-40, 40)) for _ in range(700)} | {(5000 + x, 70_000) for x in range(9)}
    edge = {c for c in cells if c[0] in (-3, -2) or rng.random() < 0.02} | {(30, 30)}
    for ends in (edge, {(17, 4)}):
        got = {(r.x_bin, r.y_bin): r.d2 for r in neighbors.nearest_boundary(frame(spark, cells), frame(spark, ends), tile_bits=4).collect()}
        assert got == {(x, y): min((a - x) ** 2 + (b - y) ** 2 for a, b in ends) for x, y in cells}
    none = neighbors.nearest_boundary(frame(spark, cells), frame(spark, set())).collect()
    assert len(none) == len(cells) and all(r.d2 is None for r in none)


def test_disc_sums_over_tiles(spark):
    rng = random.Random(3)
    cells = {(x, y) for x in range(-40, 30) for y in range(-20, 20) if rng.random() < 0.7} | {(500, 500)}
    scores = [(x, y, g, rng.choice([0.0, 0.0, rng.random()])) for x, y in cells for g in "abc" if rng.random() < 0.4]
    density = {(r.x_bin, r.y_bin, r.radius_um): r.density for r in interface.radius_density(frame(spark, cells), (40, 120), tile_bins=16).collect()}
    table = spark.createDataFrame(scores, "x_bin int, y_bin int, marker_group string, score double")
    mixed = {(r.x_bin, r.y_bin, r.radius_um): r.heterogeneity for r in interface.radius_heterogeneity(frame(spark, cells), table, (40, 120), tile_bins=16).collect()}
    assert len(density) == 2 * len(cells)
    for (x, y) in rng.sample(sorted(cells), 150) + [(500, 500)]:
        for r in (40, 120):
            near = [(a, b) for a, b in cells if 0 < (a - x) ** 2 + (b - y) ** 2 <= r * r / 100]
            assert density[x, y, r] == len(near) / (math.pi * r * r)
            sums = {}
            for a, b, g, s in scores:
                if (a, b) != (x, y) and (a - x) ** 2 + (b - y) ** 2 <= r * r / 100:
                    sums[g] = sums.get(g, 0.0) + s
            total = sum(sums.values())
            own = mixed.get((x, y, r))
            assert (own is None) if total == 0 else np.isclose(own, 1 - sum(s * s for s in sums.values()) / total**2, atol=1e-9)
    assert (500, 500, 40) not in mixed


def test_no_bucket_is_copied_to_every_cell(spark):
    """Candidates stay few beside a dense block, near and far."""
    cells = {(x, y) for x in range(64) for y in range(64)} | {(1000 * n, -5000) for n in range(1, 9)}
    boxes = frame(spark, {(1000 * n, -5000) for n in range(1, 9)}).withColumnsRenamed({"x_bin": "tx", "y_bin": "ty"})
    near = neighbors.points_near_boxes(boxes, frame(spark, cells).withColumnsRenamed({"x_bin": "x", "y_bin": "y"}), 9, 0)
    assert near.groupBy("tx", "ty").count().agg(F.max("count")).first()[0] < 64
    assert CELL == ("x_bin", "y_bin")
