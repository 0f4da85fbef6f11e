"""The long jobs on small lattices: invariants of their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binfields.operators.grid import CELL
from binfields.plans import jobs


@pytest.fixture(scope="module")
def fields_of_cells(spark):
    """Cells with the wide fields that clustering reads: three regions, some noise, some cells without fields."""
    rng = np.random.default_rng(5)
    rows = []
    for x in range(24):
        for y in range(16):
            k = 0 if x < 8 else 1 if x < 16 else 2
            own = [float(v) for s in (15, 30, 45) for v in (10 + 5 * k + rng.normal(0, 1), 3 - k + rng.normal(0, 0.3), (k - 1) + rng.normal(0, 0.3))]
            rows.append((x, y, 20 + 30 * k + int(rng.integers(0, 9)), float(rng.uniform(0.3, 1)), *(None if (x, y) == (3, 3) else v for v in own)))
    names = [f"{f}_s{s}" for s in (15, 30, 45) for f in jobs.FEATURES]
    df = spark.createDataFrame(rows, "x_bin int, y_bin int, transcript_count long, confidence_weight double, " + ", ".join(f"`{n}` double" for n in names)).cache()
    df.count()
    return df


def test_segmentation_finds_the_regions(fields_of_cells):
    out = jobs.segmentation(fields_of_cells, ks=(2, 3, 4), fits=3, rounds=15, starts=2, sweeps=6, repeats=3)
    rows = {(r.x_bin, r.y_bin): r for r in out.collect()}
    assert len(rows) == 24 * 16 and rows[3, 3].label_smooth == -1 and rows[3, 3].total_energy is None
    labels = {c: r.label_smooth for c, r in rows.items() if c != (3, 3)}
    assert set(labels.values()) == {0, 1, 2}
    # numbered by median count, which rises from region to region
    assert np.mean([label == (0 if x < 8 else 1 if x < 16 else 2) for (x, _), label in labels.items()]) > 0.97
    assert all(r.total_energy == pytest.approx(r.data_energy + r.smooth_energy) and 0 <= r.label_confidence <= 1 for c, r in rows.items() if c != (3, 3))


def test_sweep_has_every_scale_and_weight_and_its_matrices(fields_of_cells):
    table = jobs.sigma_lambda_table(fields_of_cells, k=3, factors=(0.5, 2.0), rounds=10, starts=2, sweeps=4, repeats=3).cache()
    rows = table.collect()
    assert sorted((r.sigma_um, r.factor) for r in rows) == [(s, f) for s in (15.0, 30.0, 45.0) for f in (0.5, 2.0)]
    for r in rows:
        assert r.total_energy == pytest.approx(r.data_energy + r.smooth_energy) and r.n_cells == 24 * 16 - 1 and 1 <= r.n_labels <= 3
        assert 0 <= r.boundary_ratio <= 1 and -1 <= r.stability <= 1 and r.objective == pytest.approx(r.stability - 0.1 * r.boundary_ratio)
    for s in (15.0, 30.0, 45.0):
        own = {r.factor: r.boundary_ratio for r in rows if r.sigma_um == s}
        assert own[2.0] <= own[0.5] + 1e-9
    for value in ("stability", "boundary_ratio", "objective"):
        matrix = {r.sigma_um: r.asDict() for r in jobs.sigma_lambda_matrix(table, value, (0.5, 2.0)).collect()}
        assert all(matrix[r.sigma_um][str(r.factor)] == r[value] for r in rows)


def test_labels_of_each_scale(fields_of_cells):
    rows = jobs.scale_labels(fields_of_cells, k=3, rounds=15).collect()
    assert len(rows) == 3 * (24 * 16 - 1)
    for s in (15.0, 30.0, 45.0):
        own = [r for r in rows if r.sigma_um == s]
        middles = [np.median([r.transcript_count for r in own if r.cluster_sorted == k]) for k in range(3)]
        assert middles == sorted(middles)
        assert np.mean([r.cluster_sorted == (0 if r.x_bin < 8 else 1 if r.x_bin < 16 else 2) for r in own]) > 0.9
    with pytest.raises(ValueError):
        jobs.scale_labels(fields_of_cells, k=3, least_cells=10_000)


def test_fields_of_a_lattice(spark):
    rng = np.random.default_rng(6)
    rows = [(x, y, int(rng.integers(5, 60)), 10.0 * x + 5, 10.0 * y + 5, 10 + 0.1 * x - 0.05 * y + rng.normal(0, 0.5)) for x in range(16) for y in range(12)]
    cells = spark.createDataFrame([(*r[:5], float(r[5])) for r in rows], "x_bin int, y_bin int, transcript_count long, x_um double, y_um double, z_mean_um double")
    out = jobs.cell_fields(cells).cache()
    assert out.count() == len(rows) == out.select(*CELL).distinct().count()
    assert {f"{f}_s{s}" for f in jobs.FEATURES for s in (15, 30, 45)} <= set(out.columns)
    low, high, far = out.agg(F.min("confidence_weight"), F.max("confidence_weight"), F.max(F.abs(F.col("z_residual") - (F.col("z_mean_um") - F.col("z_baseline"))))).first()
    assert 0 <= low <= high <= 1 and far < 1e-9
    # the plane goes
    assert abs(out.select(F.corr("z_residual", "x_um")).first()[0]) < 0.3


def test_interface_tables(spark):
    rng = np.random.default_rng(7)
    cells = spark.createDataFrame([(x, y, "A" if x >= 10 else "B", 1 if x >= 10 else 2, int(20 + x)) for x in range(20) for y in range(10)], "x_bin int, y_bin int, region string, cluster_sorted int, transcript_count long")
    counts = spark.createDataFrame([(x, y, g, float(rng.integers(1, 50) * (3 if (g in "ab") == (x >= 10) else 1)), 1) for x in range(20) for y in range(10) for g in "abcd"], "x_bin int, y_bin int, feature_name string, cpm double, count long")
    groups = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", "two")], "gene string, group string")
    tables = jobs.interface_job(cells, counts, groups, "B", "A", ["transcript_count"])
    signed = {(r.x_bin, r.y_bin): r for r in tables["signed"].collect()}
    assert len(signed) == 200 and signed[0, 0].signed_dist_um == -70.0 and signed[19, 0].signed_dist_um == 70.0 and signed[9, 5].is_boundary
    effects = {r.marker_group: r.cohens_d for r in tables["test"].collect()}
    assert effects["one"] > 0.5 > -0.5 > effects["two"]
    assert tables["scores"].count() == 400 and {r.feature for r in tables["metrics"].collect()} == {"one", "two", "transcript_count"}
    assert tables["heatmap"].count() > 0
