import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binfields.operators import baseline, fields, mixture, potts, smoothing
from binfields.operators.grid import CELL


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(x, y, int(rng.integers(1, 40)), float(rng.normal(x > 70, 0.3))) for x in range(55, 80) for y in range(-8, 8) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "x_bin int, y_bin int, transcript_count long, z_residual double").cache()
    df.count()
    return df


def brute(cells, sigma, prior, min_half=8):
    rows = [tuple(r) for r in cells.select("x_bin", "y_bin", "transcript_count", "z_residual").collect()]
    out = {}
    for x, y, _, _ in rows:
        near = sorted((z, n * math.exp(-0.5 * 100 * ((a - x) ** 2 + (b - y) ** 2) / sigma**2)) for a, b, n, z in rows if 100 * ((a - x) ** 2 + (b - y) ** 2) <= 9 * sigma**2)
        z, w = np.array(near).T

        def spread(keep, z=z, w=w):
            m = np.average(z[keep], weights=w[keep])
            return math.sqrt(np.average((z[keep] - m) ** 2, weights=w[keep]))

        def quantile(q, z=z, w=w):
            return z[int((np.cumsum(w) < q * w.sum()).sum())]

        up = z >= quantile(0.5)
        halves = []
        for keep in (up, ~up):
            share = min(keep.sum() / min_half, 1)
            halves.append(math.sqrt(share * (spread(keep) ** 2 if keep.any() else prior) + (1 - share) * prior))
        q1, q2 = quantile(1 / 3), quantile(2 / 3)
        p = np.array([w[z < q1].sum(), w[(z >= q1) & (z < q2)].sum(), w[z >= q2].sum()]) / w.sum()
        out[x, y] = (w.sum() / (2 * math.pi * sigma**2), spread(z < np.inf), halves[0] - halves[1], 1 - (p**2).sum() if q2 > q1 else None, len(z), int(up.sum()))
    return out


def test_tile_kernel_equals_brute_force_across_tile_borders(cells):
    prior = cells.agg(F.var_pop("z_residual")).first()[0]
    want = brute(cells, 15.0, prior)
    for r in fields.sigma_fields(cells, [15.0], tile_bins=8).collect():
        own = want[r.x_bin, r.y_bin]
        assert (r.n_neighbor, r.n_up) == own[4:]
        got = (r.rho_sigma, r.z_std_all_sigma, r.z_std_diff_sigma, r.mixing_sigma)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, own[:4], strict=True))


def test_kernel_density_in_both_forms(cells):
    tiled = {(r.x_bin, r.y_bin): r.rho_sigma for r in fields.sigma_fields(cells, [15.0]).collect()}
    for r in fields.kernel_density(cells, 15.0).collect():
        assert r.rho == pytest.approx(tiled[r.x_bin, r.y_bin])


def test_surface_recovers_a_plane_in_spite_of_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(x, y, x * 10.0, y * 10.0, 10, 3 + 0.5 * x - 0.2 * y + rng.normal(0, 0.05) + (50 if rng.random() < 0.1 else 0)) for x in range(20) for y in range(20)]
    df = spark.createDataFrame([tuple(float(v) if k > 1 and k != 4 else int(v) for k, v in enumerate(r)) for r in rows], "x_bin int, y_bin int, x_um double, y_um double, transcript_count long, z_mean_um double")
    surface = baseline.baseline_surface(df)
    based = baseline.baseline_residual(df, surface, df)
    assert based.select(F.median(F.abs("z_residual"))).first()[0] < 0.1
    assert based.agg(F.avg("baseline_inlier")).first()[0] > 0.8


def test_moran_and_subsamples(spark, cells):
    i = baseline.morans_i(cells, "z_residual").first().moran_i
    assert i > 0.3 and baseline.moran_p(cells, "z_residual", permutations=49) == 0.02
    for n in (1, 5):
        some = {tuple(r) for r in baseline.uniform_subsample(cells.repartition(n), 20).select(*CELL).collect()}
        assert len(some) == 20 and some == {tuple(r) for r in baseline.uniform_subsample(cells, 20).select(*CELL).collect()}
    heavy = baseline.weighted_subsample(cells, 100).agg(F.avg("transcript_count")).first()[0]
    assert heavy > cells.agg(F.avg("transcript_count")).first()[0]


def test_moran_moments_stand_for_permutations(spark, cells):
    """All cells: the same p as permutations where these reach their least, and about the same where they don't."""
    assert baseline.moran_p(cells, "z_residual", most=None) == pytest.approx(0.001, abs=1e-6)
    rng = np.random.default_rng(11)
    for strength in (0.0, 0.06):
        rows = [(x, y, float(rng.normal() + strength * np.sin(x / 3))) for x in range(18) for y in range(12)]
        df = spark.createDataFrame(rows, "x_bin int, y_bin int, v double").cache()
        assert abs(baseline.moran_p(df, "v", most=None) - baseline.moran_p(df, "v")) < 0.06
    assert baseline.moran_moments(df, "v").first().moran_i == pytest.approx(baseline.morans_i(df, "v", most=None).first().moran_i)
    few = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (9, 9, 1.5)], "x_bin int, y_bin int, v double")
    flat = df.withColumn("v", F.lit(2.0))
    assert baseline.moran_p(few, "v", most=None) == 1.0 and baseline.moran_p(flat, "v", most=None) == 1.0


def test_mixtures_of_several_keys_in_one_pass(spark, cells):
    """Keyed fits equal fits of their own cells; starts come from all cells."""
    z = F.col("z_residual")
    two = cells.select("x_bin", "y_bin", F.lit(15.0).alias("s"), z.alias("v")).unionByName(cells.select("x_bin", "y_bin", F.lit(30.0).alias("s"), (z * z).alias("v")))
    scaled = mixture.standardize(two, ["v"], keys=["s"]).cache()
    keyed = mixture.fit_mixtures(scaled, [(2, 1.0, 15.0), (3, 1.0, 30.0)], key="s")
    for model, s, k in zip(keyed, (15.0, 30.0), (2, 3), strict=True):
        alone = mixture.fit_mixtures(scaled.filter(F.col("s") == s), [(k, 1.0, s)], key="s")[0]
        assert model["log_likelihood"] == pytest.approx(alone["log_likelihood"], rel=0.02)
        assert model["n"] == cells.count()
    rows = mixture.posterior(scaled, dict(zip((15.0, 30.0), keyed, strict=True)), key="s").collect()
    assert {(r.s, len(r.posterior)) for r in rows} == {(15.0, 2), (30.0, 3)}
    far = spark.createDataFrame([(i, 0, [float(i % 2)]) for i in range(3000)] + [(5000 + i, 1, [400.0 + i % 3]) for i in range(6)], "x_bin int, y_bin int, features array<double>")
    model = mixture.fit_mixtures(far, [(3, 1.0)])[0]  # a small group far away has its own centre
    assert model["means"].max() == pytest.approx(401, abs=1)


def test_mixture_finds_two_groups(cells):
    scaled = mixture.standardize(cells, ["z_residual"])
    model = mixture.gmm_diag(scaled, 2)
    assert model["weights"].sum() == pytest.approx(1.0) and abs(model["means"][0, 0] - model["means"][1, 0]) > 1
    rows = mixture.posterior(scaled, model).select("posterior").collect()
    assert all(sum(r.posterior) == pytest.approx(1.0) for r in rows)
    short, long = (mixture.gmm_diag(scaled, 2, rounds=n)["log_likelihood"] for n in (1, 15))
    assert long >= short - 1e-6
    with pytest.raises(ValueError):
        mixture.standardize(cells, ["z_residual"], forbidden=["z_residual"])


@pytest.fixture(scope="module")
def lattice(spark, cells):
    """Cells with three energies, and their weighted edges."""
    from binfields.operators.neighbors import edge_similarity, lattice_edges

    z = F.col("z_residual")
    own = cells.select(*CELL, F.array(F.abs(z), F.abs(z - 1), F.abs(z + 1)).alias("unary"), F.array(z).alias("features")).withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int"))
    return own.cache(), edge_similarity(lattice_edges(own), own).cache()


@pytest.mark.parametrize("bins", [4, 8, 64])
def test_smoothing_never_raises_the_energy(lattice, bins):
    """Each move lowers it, over tile borders as inside; at the end no cell has a better label."""
    own, edges = lattice
    unary = {(r.x_bin, r.y_bin): r.unary for r in own.collect()}
    near = {c: [] for c in unary}
    for r in edges.collect():
        near[r.x_bin, r.y_bin].append(((r.nx, r.ny), r.w))
        near[r.nx, r.ny].append(((r.x_bin, r.y_bin), r.w))

    def energy(labels, lam):
        cut = sum(w for c in near for d, w in near[c] if labels[c] != labels[d]) / 2
        return sum(unary[c][k] for c, k in labels.items()) + lam * cut

    weights, last = [0.2, 0.5, 1.5], None
    begun = own.select(*CELL, "unary", F.array(*["label_raw"] * 3).alias("labels"))
    state = smoothing.TileRuns(begun, edges, {(): weights}, tile_bins=bins)
    for _ in range(6):
        rows = {(r.x_bin, r.y_bin): r.labels for r in state.cells().collect()}
        assert rows.keys() == unary.keys()
        now = [energy({c: v[n] for c, v in rows.items()}, lam) for n, lam in enumerate(weights)]
        assert last is None or all(a <= b + 1e-9 for a, b in zip(now, last, strict=True))
        told = {r.run: r.data_energy + weights[r.run] * r.cut for r in state.energies().collect()}
        assert [told[n] for n in range(3)] == pytest.approx(now)
        last = now
        state.run(1, 1)
    final = {(r.x_bin, r.y_bin): r.labels for r in state.run(20).cells().collect()}
    for n, lam in enumerate(weights):
        for c, own_energy in unary.items():
            cost = [u + lam * sum(w for d, w in near[c] if final[d][n] != k) for k, u in enumerate(own_energy)]
            assert cost[final[c][n]] <= min(cost) + 1e-9
    assert any(final[c][2] != final[c][0] for c in final)


def test_tiles_agree_with_one_tile_on_what_runs_leave_out(lattice):
    own, edges = lattice
    half = F.when(F.pmod("x_bin", F.lit(5)) == 0, -1).otherwise(F.col("label_raw"))
    begun = own.select(*CELL, "unary", F.array(half, F.col("label_raw")).alias("labels"))
    for bins in (6, 64):
        rows = smoothing.TileRuns(begun, edges, {(): [0.7, 0.7]}, tile_bins=bins).run(8).cells().collect()
        assert all((r.labels[0] == -1) == (r.x_bin % 5 == 0) and r.labels[1] >= 0 for r in rows)


def test_pair_tables_count_every_pair_of_runs(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(-1, 3, (200, 4))
    rows = spark.createDataFrame([(float(i % 2), r.tolist()) for i, r in enumerate(labels)], "s double, labels array<int>").repartition(3)
    found = {(r.s, r.group, r.pair, r.a, r.b): r.n for r in smoothing.pair_tables(rows, ["s"], {(0.0,): [[0, 1, 3]], (1.0,): [[2, 3], [0, 1]]}, 3).collect()}
    want = {}
    for i, r in enumerate(labels):
        for g, runs in enumerate([[0, 1, 3]] if i % 2 == 0 else [[2, 3], [0, 1]]):
            for p in range(len(runs)):
                for q in range(p + 1, len(runs)):
                    a, b = int(r[runs[p]]), int(r[runs[q]])
                    if a >= 0 and b >= 0:
                        key = (float(i % 2), g, p * len(runs) + q, a, b)
                        want[key] = want.get(key, 0) + 1
    assert found == want


def test_select_k(spark):
    table = spark.createDataFrame([(2, 10.0, 0.9), (3, 5.0, 0.8), (4, 1.0, 0.2), (5, 0.5, None)], "k int, icl double, stability double")
    assert mixture.select_k(table).first().k == 3
    assert mixture.select_k(table.filter("k >= 4")).first().k == 4


def test_starts_weights_and_scales_advance_together(spark, lattice):
    """Several starts never end above the first one alone; keyed runs equal runs of their own."""
    own, edges = lattice
    one = {v: potts.potts_energy(edges, potts.potts_icm(own, edges, v, sweeps=2), v).first().total_energy for v in (0.3, 0.9)}
    many = potts.smoothed(own, edges, [0.3, 0.9], starts=3, sweeps=2)
    found = {r["lambda"]: r.total_energy for r in potts.potts_energy(edges, many, "lambda", keys=["lambda"]).collect()}
    assert many.count() == 2 * own.count() and all(found[v] <= one[v] + 1e-9 for v in one)
    scaled = own.crossJoin(spark.createDataFrame([(15.0,), (30.0,)], "sigma_um double")).withColumn("lams", F.array(F.lit(0.3), F.lit(0.9)))
    near = edges.crossJoin(spark.createDataFrame([(15.0,), (30.0,)], "sigma_um double"))
    keyed = potts.lambda_stability(scaled, near, "lams", repeats=3, sweeps=1, keys=["sigma_um"]).collect()
    plain = {r["lambda"]: r.stability for r in potts.lambda_stability(own, edges, [0.3, 0.9], repeats=3, sweeps=1).collect()}
    assert len(keyed) == 4 and all(abs(r.stability - plain[r["lambda"]]) < 1e-9 and r.stability <= 1 for r in keyed)
    smooth = potts.smoothed(scaled, near, "lams", starts=3, sweeps=2, keys=["sigma_um"])
    apart = potts.potts_energy(near, smooth, "lambda", keys=["sigma_um", "lambda"]).collect()
    assert len(apart) == 4 and all(r.total_energy == pytest.approx(found[r["lambda"]]) for r in apart)
