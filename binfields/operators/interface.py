"""Radius sweeps and profiles across the interface of two regions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.functions.ranks import partial_spearman, spearman
from binfields.functions.scalar import distance_bin
from binfields.functions.summary import cohens_d
from binfields.operators.grid import BIN_SIZE_UM, CELL
from binfields.operators.markers import two_sided
from binfields.operators.neighbors import with_halo
from binfields.sources.scratch import checkpoint

# Radii and distance windows.
RADII = (40, 60, 80, 100, 120)
NEG_WINDOW, POS_WINDOW, SLOPE_WINDOW = (-150.0, -30.0), (30.0, 150.0), (-60.0, 60.0)


def in_window(d: Column, window: tuple[float, float]) -> Column:
    return d.between(*window)


def _disc_sums(raster: np.ndarray, radius: float, halo: int) -> np.ndarray:
    """Sums over the disc of ``radius`` bins around each inner place of rasters (.., x, y): an interval of each row, by prefix sums."""
    n, m = raster.shape[-2] - 2 * halo, raster.shape[-1] - 2 * halo
    below = np.concatenate([np.zeros((*raster.shape[:-1], 1), raster.dtype), np.cumsum(raster, axis=-1)], axis=-1)
    out = np.zeros((*raster.shape[:-2], n, m), raster.dtype)
    for dx in range(-int(radius), int(radius) + 1):
        half = math.isqrt(int(radius * radius - dx * dx + 1e-9))
        rows = below[..., halo + dx : halo + dx + n, :]
        out += rows[..., halo + half + 1 : halo + half + 1 + m] - rows[..., halo - half : halo - half + m]
    return out


def _by_tile(rows: DataFrame, radii: Sequence[int], size: float, tile_bins: int):
    """Cells by tile with the halo of the largest radius: a cell is copied about twice, not to each neighbour."""
    return with_halo(rows, tile_bins, int(max(radii) // size)).groupBy("tile_x", "tile_y")


def _inner(key: tuple, tile: pa.Table, halo: int, bins: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], pa.Table]:
    """Places of all cells in a raster with the halo, of core cells in one without, and the core cells."""
    core = tile.column("core").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    at = tuple(tile.column(c).combine_chunks().to_numpy().astype(np.int64) - k.as_py() * bins for c, k in zip(CELL, key, strict=True))
    return tuple(a + halo for a in at), tuple(a[core] for a in at), tile.filter(pa.array(core))


def radius_density(cells: DataFrame, radii: Sequence[int] = RADII, size: float = BIN_SIZE_UM, tile_bins: int = 64) -> DataFrame:
    """x_bin, y_bin, radius_um, density: other cells within each radius over its area."""
    halo, radii = int(max(radii) // size), tuple(radii)

    def count(key: tuple, tile: pa.Table) -> pa.Table:
        at, inner, core = _inner(key, tile, halo, tile_bins)
        there = np.zeros((tile_bins + 2 * halo,) * 2, np.int64)
        there[at] = 1
        parts = [pa.table({"x_bin": core.column("x_bin"), "y_bin": core.column("y_bin"), "radius_um": pa.array(np.full(len(core), r, np.int32)), "density": pa.array((_disc_sums(there, r / size, halo)[inner] - 1) / (math.pi * r * r))}) for r in radii]
        return pa.concat_tables(parts)

    return _by_tile(cells.select(*CELL), radii, size, tile_bins).applyInArrow(count, "x_bin int, y_bin int, radius_um int, density double")


def radius_heterogeneity(cells: DataFrame, scores: DataFrame, radii: Sequence[int] = RADII, size: float = BIN_SIZE_UM, tile_bins: int = 64) -> DataFrame:
    """x_bin, y_bin, radius_um, heterogeneity = 1 - sum of squared shares of the neighbours' scores by group; null without any score.

    Cells without a scored neighbour in the largest radius have no row.
    """
    halo, radii = int(max(radii) // size), tuple(radii)
    names = [r["marker_group"] for r in scores.select("marker_group").distinct().orderBy("marker_group").collect()]  # a panel of groups
    places = F.array(*(F.coalesce(F.max(F.when(F.col("marker_group") == n, F.col("score").cast("double"))), F.lit(0.0)) for n in names)) if names else F.array().cast("array<double>")
    by_cell = scores.filter(F.col("marker_group").isNotNull()).groupBy(*CELL).agg(places.alias("own"))
    rows = cells.select(*CELL).withColumn("asked", F.lit(True)).join(by_cell, list(CELL), "full")

    def mix(key: tuple, tile: pa.Table) -> pa.Table:
        at, inner, core = _inner(key, tile, halo, tile_bins)
        scored, shape = tile.column("own").combine_chunks().is_valid().to_numpy(zero_copy_only=False), (tile_bins + 2 * halo,) * 2
        there, values = np.zeros(shape, np.int64), np.zeros((len(names), *shape))
        place = tuple(a[scored] for a in at)
        there[place] = 1
        if len(names):
            values[:, place[0], place[1]] = tile.column("own").combine_chunks().drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)).T
        asked = core.column("asked").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        here = there[tuple(a + halo for a in inner)]
        asked &= _disc_sums(there, max(radii) / size, halo)[inner] - here > 0
        own, centre = tuple(a[asked] for a in inner), tuple(a[asked] + halo for a in inner)
        parts = []
        for r in radii:
            # whole numbers tell where nothing was added, as differences of sums may leave a rest
            filled = _disc_sums((values != 0).astype(np.int64), r / size, halo)[:, own[0], own[1]] - (values != 0)[:, centre[0], centre[1]]
            sums = np.where(filled > 0, _disc_sums(values, r / size, halo)[:, own[0], own[1]] - values[:, centre[0], centre[1]], 0.0)
            total = sums.sum(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                mixed = 1 - (sums * sums).sum(0) / (total * total)
            parts.append(pa.table({"x_bin": core.column("x_bin").filter(pa.array(asked)), "y_bin": core.column("y_bin").filter(pa.array(asked)), "radius_um": pa.array(np.full(len(total), r, np.int32)), "heterogeneity": pa.array(mixed, mask=~(total > 0))}))
        return pa.concat_tables(parts)

    return _by_tile(rows, radii, size, tile_bins).applyInArrow(mix, "x_bin int, y_bin int, radius_um int, heterogeneity double")


def radius_sweep(cells: DataFrame, density: DataFrame, heterogeneity: DataFrame, value: str, region: str = "region") -> DataFrame:
    """Per radius and region: Spearman and partial Spearman (given the log count) of the value with both neighbourhood measures."""
    base = cells.select(*CELL, region, value, F.log1p("transcript_count").alias("_cov"))
    # four rank statistics read these rows, each several times
    rows = checkpoint(base.join(density, list(CELL)).join(heterogeneity, [*CELL, "radius_um"], "left"))
    keys, out = ["radius_um", region], None
    for measure, name in (("density", "density"), ("heterogeneity", "heter_soft")):
        plain = spearman(rows, value, measure, keys, name=f"rho_z_{name}").drop("n")
        partial = partial_spearman(rows, value, measure, "_cov", keys, name=f"partial_rho_z_{name}").drop("n")
        both = plain.join(partial, keys, "left")
        out = both if out is None else out.join(both, keys, "left")
    return out


def unpivot_features(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: kept columns, feature, value."""
    return rows.unpivot(list(keep), list(features), "feature", "value")


def distance_profile(long: DataFrame, low: float = -400.0, high: float = 400.0, width: float = 40.0, least: int = 20, finite_only: bool = True) -> DataFrame:
    """feature, dist_bin (centre), mean_value, n: bins with too few rows go. Without ``finite_only`` rows without a value count as well."""
    n = F.count("value") if finite_only else F.count("*")
    binned = long.withColumn("dist_bin", distance_bin(F.col("signed_dist_um"), low, high, width)).filter("dist_bin is not null")
    return binned.groupBy("feature", "dist_bin").agg(F.avg("value").alias("mean_value"), n.alias("n")).filter(F.col("n") >= least)


def profile_zscore(profile: DataFrame) -> DataFrame:
    """Adds zscore across a feature's bins (sample spread; none gives null)."""
    own = Window.partitionBy("feature")
    return profile.withColumn("zscore", F.try_divide(F.col("mean_value") - F.avg("mean_value").over(own), F.nullif(F.stddev_samp("mean_value").over(own), F.lit(0.0))))


def profile_gradient(profile: DataFrame, least_bins: int = 3) -> DataFrame:
    """feature, grad_max_abs_per_um between consecutive kept bins."""
    order = Window.partitionBy("feature").orderBy("dist_bin")
    steps = profile.withColumn("_g", F.abs((F.col("mean_value") - F.lag("mean_value").over(order)) / (F.col("dist_bin") - F.lag("dist_bin").over(order))))
    return steps.groupBy("feature").agg(F.when(F.count("*") >= least_bins, F.max("_g")).alias("grad_max_abs_per_um"))


def peak_order(profile: DataFrame, value: str = "zscore") -> DataFrame:
    """feature, peak_bin (the first maximum), place in the order of peaks."""
    peaks = profile.filter(F.col(value).isNotNull()).groupBy("feature").agg(F.max_by("dist_bin", F.struct(F.col(value), -F.col("dist_bin"))).alias("peak_bin"))
    return peaks.withColumn("place", F.row_number().over(Window.orderBy("peak_bin", "feature")))  # one row for each feature


def interface_heatmap(long: DataFrame, **bins) -> DataFrame:
    """Z-scored profiles with each feature's place by peak."""
    profile = profile_zscore(distance_profile(long, finite_only=False, **bins))
    return profile.join(peak_order(profile), "feature")


def slope_near_zero(value: Column, d: Column, least: int = 30) -> Column:
    inside = in_window(d, SLOPE_WINDOW) & value.isNotNull()
    return F.when(F.count_if(inside) >= least, F.regr_slope(F.when(inside, value), F.when(inside, d)))


def auc_separation(long: DataFrame, least: int = 10) -> DataFrame:
    """feature, auc_sep_pos_vs_neg: U / (n1 * n0) between d >= 30 and d <= -30, without outer limit."""
    d = F.col("signed_dist_um")
    sided = long.filter("value is not null").withColumn("_side", F.when(d >= POS_WINDOW[0], "A").when(d <= NEG_WINDOW[1], "B"))
    sums = two_sided(sided, ["feature"], "value", "_side")
    fine = (F.col("n1") + F.col("n2") >= least) & (F.col("n1") > 0) & (F.col("n2") > 0)
    return sums.select("feature", F.when(fine, F.try_divide(F.col("u"), F.col("n1").cast("double") * F.col("n2"))).alias("auc_sep_pos_vs_neg"))


def interface_metrics(long: DataFrame, *, least: int = 30, **bins) -> DataFrame:
    """Per feature: contrast, slope, largest gradient, AUC and four counts."""
    y, d = F.col("value"), F.col("signed_dist_um")
    rows = long.filter("value is not null and signed_dist_um is not null")
    counts = [F.count_if(in_window(d, w)).alias(n) for w, n in ((NEG_WINDOW, "n_neg_window"), (POS_WINDOW, "n_pos_window"), (SLOPE_WINDOW, "n_slope_window"))]
    base = rows.groupBy("feature").agg(
        cohens_d(y, in_window(d, POS_WINDOW), in_window(d, NEG_WINDOW)).alias("contrast_d_pos_minus_neg"), slope_near_zero(y, d).alias("slope_near0_per_um"), F.count("*").alias("n_total"), *counts
    )
    profile = distance_profile(rows, **bins)
    joined = base.filter(F.col("n_total") >= least).join(profile_gradient(profile), "feature", "left")
    return joined.join(auc_separation(rows), "feature", "left")


def metric_rank(metrics: DataFrame, by: str = "grad_max_abs_per_um") -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last(by), "feature")
