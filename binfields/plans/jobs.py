"""The long jobs: from detections to cell fields, and from fields to a segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfields.functions.ranks import order_statistics
from binfields.functions.summary import relabel_by_median
from binfields.operators import baseline, fields, interface, markers, mixture, neighbors, potts
from binfields.operators.grid import CELL
from binfields.sources.scratch import checkpoint

# Clustering features and smoothing weights tried.
FEATURES = ("rho_sigma", "z_std_all_sigma", "z_std_diff_enhanced")
LAMBDA_FACTORS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def cell_fields(cells: DataFrame, sigmas: Sequence[float] = fields.SIGMAS, corr_mode: str = "reflect_bbox") -> DataFrame:
    """Cells with their residual from the baseline, the fields of every scale (wide) and the confidence at the scale nearest 30."""
    cells = checkpoint(cells)
    flat = cells.withColumn("z_residual", F.lit(0.0))
    pilot = fields.sigma_fields(flat, [50.0], corr_mode=corr_mode).select(*CELL, F.col("rho_sigma").alias("rho"))
    region = checkpoint(cells.join(baseline.fit_region(checkpoint(pilot)).select(*CELL), list(CELL), "left_semi"))
    linear, quadratic = baseline.baseline_surface(region, "linear"), baseline.baseline_surface(region, "quadratic", seed=baseline.SEED + 1)
    surface = baseline.choose_surface(linear, quadratic)
    based = checkpoint(baseline.baseline_residual(cells, surface, region))

    def trend(rows: DataFrame, seed: int) -> bool:
        i = baseline.morans_i(rows, "z_residual").first()["moran_i"]
        return i is not None and abs(i) >= 0.03 and baseline.trend_remains(i, baseline.moran_p(rows, "z_residual", seed=seed))

    remains = trend(based, baseline.SEED + 17)
    if remains and surface["order"] == "linear":
        based = checkpoint(baseline.baseline_residual(cells, quadratic, region))
        remains = trend(based, baseline.SEED + 40)
    guarded = checkpoint(baseline.trend_guard(based, remains))
    long = checkpoint(fields.enhanced(fields.sigma_fields(guarded, sigmas, corr_mode=corr_mode)))
    reference = min(sigmas, key=lambda s: abs(s - 30.0))
    local = long.filter(F.col("sigma_um") == reference).join(guarded.select(*CELL, "local_scale"), list(CELL))
    confidence = fields.confidence_weight(local, local_scale=F.col("local_scale")).select(*CELL, "confidence_weight")
    wide = fields.wide_fields(long, FEATURES, sigmas)
    return checkpoint(guarded.join(wide, list(CELL)).join(confidence, list(CELL)))


def lambda_table(own: DataFrame, edges: DataFrame, factors: Sequence[float], *, starts: int, sweeps: int) -> tuple[DataFrame, DataFrame]:
    """Smoothed cells of every weight, and lambda, boundary_ratio, pseudo_likelihood; weights are factors of the energy margin."""
    base = potts.unary_margin(own).first()["lambda0"]
    solved = potts.smoothed(own, edges, [f * base for f in factors], starts=starts, sweeps=sweeps)
    ratio = potts.boundary_ratio(edges, solved, keys=["lambda"])
    return solved, checkpoint(potts.pseudo_likelihood(solved, edges, "lambda", keys=["lambda"]).join(ratio, "lambda", "left"))


def segmentation(
    cells: DataFrame,
    *,
    ks: Sequence[int] = tuple(range(2, 9)),
    fits: int = 8,
    rounds: int = 40,
    starts: int = 6,
    sweeps: int = 10,
    factors: Sequence[float] = LAMBDA_FACTORS,
    mode: str = "stability",
    repeats: int = 20,
    top: int = 3,
) -> DataFrame:
    """Labels of all cells: mixture with the chosen number of components, smoothed with the chosen weight, numbered by median count.

    In stability mode the ``top`` weights by pseudo-likelihood less a tenth of the boundary ratio are run on subsamples.
    """
    spark = cells.sparkSession
    names = [c for c in cells.columns if c.startswith(tuple(f"{f}_s" for f in FEATURES))]
    scaled = checkpoint(mixture.standardize(cells, names))
    table = mixture.fit_mixtures(scaled, [(k, 1.0) for k in ks], rounds=rounds)
    stability = mixture.k_stability(scaled, ks, fits=fits, rounds=rounds)
    rows = [(k, float(m["icl"]), stability.get(k)) for k, m in zip(ks, table, strict=True)]
    k = mixture.select_k(spark.createDataFrame(rows, "k int, icl double, stability double")).first()["k"]
    own = checkpoint(potts.unary_energy(mixture.posterior(scaled, table[list(ks).index(k)])))
    edges = checkpoint(neighbors.edge_similarity(neighbors.lattice_edges(own), own))
    solved, tried = lambda_table(own, edges, factors, starts=starts, sweeps=sweeps)
    if mode == "stability":
        first = [r["lambda"] for r in tried.orderBy(F.desc_nulls_last(F.col("pseudo_likelihood") - 0.1 * F.coalesce("boundary_ratio", F.lit(0.0))), "lambda").limit(top).collect()]
        tried = checkpoint(tried.join(F.broadcast(potts.lambda_stability(own, edges, first, repeats=repeats)), "lambda", "left"))
    best = potts.select_lambda(tried, mode).first()["lambda"]
    smooth = solved.filter(F.col("lambda") == best).drop("lambda")
    energies = potts.cell_energies(smooth, edges, best).withColumn("label_confidence", F.array_max("posterior") * F.coalesce("confidence_weight", F.lit(0.5)))
    named = relabel_by_median(energies, "label", "transcript_count", "label_smooth")
    return potts.labels_writeback(cells.select(*CELL, "transcript_count"), named.drop("label"), ["label_raw", "data_energy", "smooth_energy", "total_energy", "label_confidence"], "label_smooth")


def by_scale(cells: DataFrame, sigmas: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """sigma_um, x_bin, y_bin, kept columns, features: every cell once for each scale, standardized within the scale."""
    structs = [F.struct(F.lit(float(s)).alias("sigma_um"), *(F.col(f"{f}_s{int(s)}").cast("double").alias(f) for f in FEATURES)) for s in sigmas]
    long = cells.select(*CELL, *keep, F.inline(F.array(*structs)))
    return mixture.standardize(long, FEATURES, keys=["sigma_um"]).drop(*FEATURES)


def clustered_by_scale(cells: DataFrame, k: int, sigmas: Sequence[float], rounds: int, least_cells: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """``by_scale`` with posterior: the mixtures of all scales are fitted in the same passes. Scales with too few cells go."""
    long = checkpoint(by_scale(cells, sigmas, keep))
    enough = sorted(r["sigma_um"] for r in long.groupBy("sigma_um").count().filter(F.col("count") >= least_cells).collect())
    if not enough:
        raise ValueError("no scale has enough cells")
    models = mixture.fit_mixtures(long, [(k, 1.0, s) for s in enough], rounds=rounds, key="sigma_um")
    return checkpoint(mixture.posterior(long.filter(F.col("sigma_um").isin(enough)), dict(zip(enough, models, strict=True)), key="sigma_um"))


def sigma_lambda_table(cells: DataFrame, *, k: int = 4, factors: Sequence[float] = LAMBDA_FACTORS, sigmas: Sequence[float] = fields.SIGMAS, rounds: int = 40, starts: int = 3, sweeps: int = 8, repeats: int = 6) -> DataFrame:
    """For every scale and smoothing weight: boundary ratio, the three energies, stability on subsamples, objective, and the cells.

    Scales are a key of one plan: of the mixtures, the edges and the smoothing runs.
    """
    own = checkpoint(potts.unary_energy(clustered_by_scale(cells, k, sigmas, rounds, keep=["confidence_weight"])))
    scales = sorted(r["sigma_um"] for r in own.select("sigma_um").distinct().collect())
    base = {s: potts.unary_margin(own.filter(F.col("sigma_um") == s)).first()["lambda0"] for s in scales}
    lams = F.create_map(*(x for s in scales for x in (F.lit(s), F.array(*(F.lit(f * base[s]) for f in factors)))))
    every = checkpoint(own.select("sigma_um", *CELL, "unary", "label_raw", "features", lams[F.col("sigma_um")].alias("lams")))
    edges = None
    for s in scales:
        one = every.filter(F.col("sigma_um") == s)
        near = neighbors.edge_similarity(neighbors.lattice_edges(one), one).select(F.lit(s).alias("sigma_um"), "*")
        edges = near if edges is None else edges.unionByName(near)
    edges, keys = checkpoint(edges), ["sigma_um", "lambda"]
    every = every.drop("features")
    solved = potts.smoothed(every, edges, "lams", starts=starts, sweeps=sweeps, keys=["sigma_um"])
    energy = potts.potts_energy(edges, solved, "lambda", keys=keys)
    ratio = potts.boundary_ratio(edges, solved, keys=keys)
    stable = potts.lambda_stability(every, edges, "lams", repeats=repeats, seed=baseline.SEED + 10_000, keys=["sigma_um"])
    bases = F.create_map(*(x for s in scales for x in (F.lit(s), F.lit(base[s]))))
    counts = solved.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.countDistinct("label").alias("n_labels")).withColumn("factor", F.round(F.col("lambda") / bases[F.col("sigma_um")], 6))
    rows = energy.join(ratio, keys, "left").join(stable, keys, "left").join(counts, keys)
    return rows.withColumn("objective", F.col("stability") - 0.1 * F.col("boundary_ratio"))


def sigma_lambda_matrix(table: DataFrame, value: str, factors: Sequence[float] = LAMBDA_FACTORS) -> DataFrame:
    """One row for each scale and one column for each factor of the weight: stability, boundary_ratio or objective."""
    return table.groupBy("sigma_um").pivot("factor", [round(float(f), 6) for f in factors]).agg(F.first(value))


def scale_labels(cells: DataFrame, *, k: int, sigmas: Sequence[float] = fields.SIGMAS, rounds: int = 40, least_cells: int = 100) -> DataFrame:
    """sigma_um, x_bin, y_bin, transcript_count, cluster_sorted: each scale clustered anew on its own features, numbered by median count."""
    chances = clustered_by_scale(cells, k, sigmas, rounds, least_cells, ["transcript_count"])
    labelled = checkpoint(chances.select("sigma_um", *CELL, "transcript_count", (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int").alias("_raw")))
    medians = order_statistics(labelled, "transcript_count", [0.5], ["sigma_um", "_raw"])
    order = Window.partitionBy("sigma_um").orderBy("q0", "_raw")  # one row for each label
    mapping = medians.select("sigma_um", "_raw", (F.row_number().over(order) - 1).alias("cluster_sorted"))
    return checkpoint(labelled.join(F.broadcast(mapping), ["sigma_um", "_raw"]).select("sigma_um", *CELL, "transcript_count", "cluster_sorted"))


def interface_job(cells: DataFrame, counts: DataFrame, groups: DataFrame, negative: str, positive: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """From labelled cells and counts to marker scores, their test between two regions, signed distances and interface metrics.

    ``cells`` has region and the feature columns; the tables are scores, test, signed, heatmap and metrics.
    """
    members = checkpoint(markers.marker_members(groups, counts))
    scores = checkpoint(markers.score_field_join(markers.marker_scores(counts, cells, members), cells, ["region"]))
    signed = checkpoint(neighbors.signed_distance(cells, negative, positive))
    wide = scores.groupBy(*CELL).pivot("marker_group", [r["marker_group"] for r in members.select("marker_group").distinct().orderBy("marker_group").collect()]).agg(F.first("score"))
    names = [c for c in wide.columns if c not in CELL]
    long = interface.unpivot_features(signed.join(wide, list(CELL)).select(*CELL, "signed_dist_um", *(F.col(f).cast("double").alias(f) for f in (*features, *names))), [*features, *names], [*CELL, "signed_dist_um"])
    long = checkpoint(long)
    return {"scores": scores, "test": markers.marker_group_test(scores), "signed": signed, "heatmap": interface.interface_heatmap(long), "metrics": interface.interface_metrics(long)}
