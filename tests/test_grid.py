import pytest
from pyspark.sql import functions as F

from binfields.operators import grid
from binfields.operators.neighbors import disc, knn_join, lattice_edges, nearest_boundary, radius_join, signed_distance

POINTS = "x_location double, y_location double, z_location double, feature_name string, qv double"


def test_filter_bins_and_counts(spark):
    rows = [(-0.5, 0.0, 1.0, "g", 10.0), (9.99, 10.0, 3.0, "g", 40.0), (5.0, 19.9, 5.0, "NegControl_1", 40.0), (5.0, 5.0, 5.0, None, 40.0), (5.0, 5.0, 5.0, "g", None), (0.0, 12.0, 5.0, "negcontrol", 10.0)]
    points = spark.createDataFrame(rows, POINTS)
    cells = {(r.x_bin, r.y_bin): (r.transcript_count, r.z_mean_um, r.x_um) for r in grid.lattice_cells(points, least=1).collect()}
    assert cells == {(-1, 0): (1, 1.0, -5.0), (0, 1): (2, 4.0, 5.0)}
    assert grid.lattice_cells(points.limit(0)).count() == 0


def test_cpm_sums_to_a_million(spark):
    counts = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 3), (1, 0, "a", 2)], "x_bin int, y_bin int, feature_name string, count long")
    got = {(r.x_bin, r.feature_name): r.cpm for r in grid.cpm(counts).collect()}
    assert got == {(0, "a"): 250000.0, (0, "b"): 750000.0, (1, "a"): 1e6}
    panel = spark.createDataFrame([("a",)], "feature_name string")
    assert grid.panel_cpm(counts, panel, least=2).select("x_bin").collect() == [(1,)]


@pytest.mark.parametrize(("radius", "n"), [(15, 9), (30, 29), (45, 69), (90, 253), (120, 441), (135, 577), (150, 709)])
def test_disc_sizes(radius, n):
    assert len(disc(float(radius))) == n


def brute_nearest(cells, k):
    out = {}
    for a in cells:
        near = sorted(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, *b) for b in cells if b != a)[:k]
        out[a] = near
    return out


def test_neighbours_on_a_lattice_with_gaps(spark):
    cells = sorted({(x * x % 23 - 5, y * 7 % 17) for x in range(9) for y in range(9)} | {(60, 60)})
    df = spark.createDataFrame(cells, "x_bin int, y_bin int").repartition(3)
    got = {}
    for r in knn_join(df, k=4).orderBy("rank").collect():
        got.setdefault((r.x_bin, r.y_bin), []).append((r.d2, r.nx, r.ny))
    assert got == brute_nearest(cells, 4)
    near = {(r.x_bin, r.y_bin, r.nx, r.ny) for r in radius_join(df, df, 30.0).collect()}
    assert near == {(*a, *b) for a in cells for b in cells if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 9}
    edges = [frozenset([(r.x_bin, r.y_bin), (r.nx, r.ny)]) for r in lattice_edges(df).collect()]
    assert len(edges) == len(set(edges)) and set(edges) == {frozenset([a, b]) for a in cells for b in cells if a != b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}
    assert knn_join(df.limit(1)).count() == 0


def test_signed_distance(spark):
    rows = [(x, 0, "A" if x >= 0 else "B") for x in range(-30, 31)]
    df = spark.createDataFrame(rows, "x_bin int, y_bin int, region string")
    got = {r.x_bin: (r.is_boundary, r.signed_dist_um) for r in signed_distance(df, "B", "A").collect()}
    assert got[2] == (True, 0.0) and got[-3] == (True, 0.0) and got[30] == (False, 280.0) and got[-30] == (False, -270.0) and got[3] == (False, 10.0)
    far = spark.createDataFrame([(500, 0)], "x_bin int, y_bin int")
    assert nearest_boundary(far, spark.createDataFrame([(0, 0), (3, 4)], "x_bin int, y_bin int")).first().d2 == 497**2 + 16


def test_finite_rows(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert grid.finite_rows(df, ["v"]).collect() == [(1.0,)]
    assert df.select(grid.region_label(F.lit(-1)).alias("r")).first().r == "Unassigned"
