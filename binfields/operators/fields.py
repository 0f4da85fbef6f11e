"""Multi-scale neighbourhood fields per cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binfields.functions.ranks import global_rank, order_statistics
from binfields.functions.scalar import clip_range, imbalance, normal_cdf
from binfields.operators.grid import BIN_SIZE_UM, CELL
from binfields.operators.neighbors import disc, radius_join, with_halo

# The scales, and how many neighbours a half needs.
SIGMAS = (15.0, 30.0, 45.0)
MIN_HALF = 8


def edge_correction(cells: DataFrame, sigma: float, mode: str = "reflect_bbox") -> DataFrame:
    """Adds corr: the share of a Gaussian around the cell that lies inside the bounding box of all centres, 1e-3 to 1.

    The share is a product of one factor for each column and one for each row of the lattice, so the normal distribution
    is evaluated once for each of those only.
    """
    if mode not in ("reflect_bbox", "renorm_mask"):
        return cells.withColumn("corr", F.lit(1.0))
    box = cells.agg(*(f(f"{a}_um").alias(f"{a}_{n}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))))
    out = cells
    for a in "xy":
        lines = cells.select(f"{a}_bin", f"{a}_um").distinct().join(F.broadcast(box))
        share = normal_cdf((F.col(f"{a}_max") - F.col(f"{a}_um")) / sigma) - normal_cdf((F.col(f"{a}_min") - F.col(f"{a}_um")) / sigma)
        out = out.join(lines.select(f"{a}_bin", share.alias(f"_{a}")), f"{a}_bin")
    return out.withColumn("corr", clip_range(F.col("_x") * F.col("_y"), 1e-3, 1.0)).drop("_x", "_y")


def kernel_density(cells: DataFrame, sigma: float, corr: str | None = None, size: float = BIN_SIZE_UM) -> DataFrame:
    """x_bin, y_bin, rho: Gaussian sum of counts within 3 sigma, self included, per unit of area."""
    near = radius_join(cells, cells.select(*CELL, "transcript_count"), 3 * sigma, size)
    kernel = F.exp(-0.5 * F.col("d2") * (size * size) / (sigma * sigma))
    summed = near.groupBy(*CELL).agg(F.sum(F.col("transcript_count") * kernel).alias("_w"), F.count("*").alias("_m"))
    mass = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("_m").cast("double"))
    out = summed.select(*CELL, (mass / (2 * np.pi * sigma * sigma)).alias("rho"))
    if corr:
        out = out.join(cells.select(*CELL, corr), list(CELL)).select(*CELL, (F.col("rho") / F.col(corr)).alias("rho"))
    return out


def _spread(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted population standard deviation down the columns; NaN without weight."""
    total = w.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (w * z).sum(0) / total
        out = np.sqrt((w * (z - mean) ** 2).sum(0) / total)
    return np.where(total > 0, out, np.nan)


def _fields_of(z: np.ndarray, w: np.ndarray, there: np.ndarray, prior: float, min_half: int) -> dict[str, np.ndarray]:
    """Order statistics of neighbours: rows are neighbours, columns are cells; ``there`` masks those that exist."""
    mass = np.where(there, w, 0.0)
    flat = ~(mass.sum(0) > 0)
    mass[:, flat] = there[:, flat]
    values = np.where(there, z, np.inf)
    order = np.argsort(values, axis=0, kind="stable")
    values, mass, there = (np.take_along_axis(a, order, 0) for a in (values, mass, there))
    z = np.where(there, values, 0.0)
    cumulative, total = np.cumsum(mass, axis=0), mass.sum(0)

    def quantile(q: float) -> np.ndarray:
        place = np.minimum((cumulative < q * total).sum(0), there.sum(0) - 1)
        return np.take_along_axis(z, place[None, :], 0)[0]

    middle, q1, q2 = quantile(0.5), quantile(1 / 3), quantile(2 / 3)
    up = there & (z >= middle)
    low = there & (z < middle)
    halves = {}
    for name, half in (("up", up), ("low", low)):
        n = half.sum(0)
        own = _spread(z, np.where(half, mass, 0.0)) ** 2
        own = np.where(np.isfinite(own), own, prior)
        share = np.minimum(n / max(min_half, 1), 1.0)
        halves[name] = np.sqrt(share * own + (1 - share) * prior)
    p1 = np.where(z < q1, mass, 0.0).sum(0) / total
    p2 = np.where((z >= q1) & (z < q2), mass, 0.0).sum(0) / total
    p3 = np.maximum(1 - p1 - p2, 0)
    mixing = np.where(q2 > q1, 1 - (p1**2 + p2**2 + p3**2), np.nan)
    return {
        "mass": total,
        "z_std_all_sigma": _spread(z, mass),
        "z_std_up_sigma": halves["up"],
        "z_std_low_sigma": halves["low"],
        "z_std_diff_sigma": halves["up"] - halves["low"],
        "mixing_sigma": mixing,
        "n_neighbor": there.sum(0),
        "n_up": up.sum(0),
        "n_low": low.sum(0),
    }


def sigma_fields(cells: DataFrame, sigmas: Sequence[float] = SIGMAS, *, z: str = "z_residual", corr_mode: str = "none", tile_bins: int = 64, min_half: int = MIN_HALF, size: float = BIN_SIZE_UM) -> DataFrame:
    """Long table cell x sigma: rho, spread of z over all, upper and lower neighbours, their difference, tercile mixing, counts.

    Order statistics over hundreds of neighbours are beyond an aggregate, so cells go by tile with a halo, all sigmas in
    one shuffle: a cell is copied to about two tiles instead of to each neighbour.
    """
    halo = max(int(3 * s // size) for s in sigmas)
    prior = cells.agg(F.greatest(F.coalesce(F.var_pop(z), F.lit(0.0)), F.lit(1e-6))).first()[0]
    rings = {s: np.array(disc(3 * s, size)) for s in sigmas}

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        core = rows[rows.core]
        if not len(core):
            return pd.DataFrame({c: [] for c in names})
        x0, y0 = int(rows.x_bin.min()) - halo, int(rows.y_bin.min()) - halo
        shape = (int(rows.x_bin.max()) - x0 + halo + 1, int(rows.y_bin.max()) - y0 + halo + 1)
        raster = {n: np.zeros(shape) for n in ("z", "count")}
        there = np.zeros(shape, bool)
        at = (rows.x_bin.to_numpy() - x0, rows.y_bin.to_numpy() - y0)
        raster["z"][at], raster["count"][at], there[at] = rows.z, rows.transcript_count, True
        parts = []
        for s, ring in rings.items():
            gauss = np.exp(-0.5 * (ring**2).sum(1) * size * size / (s * s))
            step = max(1, 2_000_000 // len(ring))  # bounds the memory of the stacks
            for begin in range(0, len(core), step):
                some = core.iloc[begin : begin + step]
                px = some.x_bin.to_numpy()[None, :] - x0 + ring[:, :1]
                py = some.y_bin.to_numpy()[None, :] - y0 + ring[:, 1:]
                found = _fields_of(raster["z"][px, py], raster["count"][px, py] * gauss[:, None], there[px, py], prior, min_half)
                out = pd.DataFrame({"x_bin": some.x_bin.to_numpy(), "y_bin": some.y_bin.to_numpy(), "sigma_um": s, **found})
                out["rho_sigma"] = out.pop("mass") / (2 * np.pi * s * s)
                parts.append(out[names])
        return pd.concat(parts, ignore_index=True)

    names = [*CELL, "sigma_um", "rho_sigma", "z_std_all_sigma", "z_std_up_sigma", "z_std_low_sigma", "z_std_diff_sigma", "mixing_sigma", "n_neighbor", "n_up", "n_low"]
    kinds = ["int", "int", *["double"] * 7, *["long"] * 3]
    spread = with_halo(cells.select(*CELL, "transcript_count", F.coalesce(z, F.lit(0.0)).alias("z")), tile_bins, halo)
    fields = spread.groupBy("tile_x", "tile_y").applyInPandas(tile, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    fields = fields.withColumn("mixing_sigma", F.nanvl("mixing_sigma", F.lit(None).cast("double")))
    if corr_mode == "none":
        return fields
    corrected = None
    for s in sigmas:
        own = edge_correction(cells, s, corr_mode).select(*CELL, F.lit(s).alias("sigma_um"), "corr")
        corrected = own if corrected is None else corrected.unionByName(own)
    return fields.join(corrected, [*CELL, "sigma_um"]).withColumn("rho_sigma", F.col("rho_sigma") / F.col("corr")).drop("corr")


def confidence_weight(fields: DataFrame, *, local_scale: Column | None = None, q: float = 0.9, exponent: float = 0.5, blend: float = 0.5) -> DataFrame:
    """Adds confidence_weight to rows of one sigma: shares of the q quantiles of neighbours and of the smaller half, blended with their rank."""
    half = F.least("n_up", "n_low")
    sizes = fields.select(F.inline(F.array(*(F.struct(F.lit(n).alias("_ref"), F.when(c > 0, c).cast("double").alias("_v")) for n, c in (("_nb", F.col("n_neighbor")), ("_hf", half))))))
    at = {r["_ref"]: r["q0"] for r in order_statistics(sizes, "_v", [q], ["_ref"]).collect()}  # two rows
    refs = {n: F.lit(float(max(at.get(n) or 1.0, 1.0))) for n in ("_nb", "_hf")}
    parts = [clip_range(F.pow(F.try_divide(n.cast("double"), refs[ref]), F.lit(exponent)), 0.0, 1.0) for n, ref in ((F.col("n_neighbor"), "_nb"), (half, "_hf"))]
    raw = clip_range(parts[0] * parts[1] * (F.lit(1.0) if local_scale is None else local_scale), 0.0, 1.0)
    return confidence_rank_blend(fields.withColumn("_raw", raw), "_raw", blend).drop("_raw")


def confidence_rank_blend(rows: DataFrame, raw: str, blend: float = 0.5, name: str = "confidence_weight") -> DataFrame:
    """(1 - blend) * raw + blend * rank scaled to 0..1; ties in rank go by bins."""
    n = rows.count()
    if blend <= 0 or n < 2:
        return rows.withColumn(name, clip_range(F.col(raw), 0.0, 1.0))
    ranked = global_rank(rows, [raw, *CELL], "_rank")
    return ranked.withColumn(name, clip_range((1 - blend) * F.col(raw) + blend * (F.col("_rank") - 1) / (n - 1), 0.0, 1.0)).drop("_rank")


def enhanced(fields: DataFrame, alpha: float = 1.5) -> DataFrame:
    """Adds the signed and absolute imbalance of the halves, and the enhanced spread difference."""
    signed = imbalance(F.col("n_up"), F.col("n_low"))
    out = fields.withColumn("imbalance_signed", signed).withColumn("imbalance_abs", F.abs("imbalance_signed"))
    return out.withColumn("z_std_diff_enhanced", F.col("z_std_diff_sigma") * (1 + alpha * F.col("imbalance_abs")))


def wide_fields(fields: DataFrame, columns: Sequence[str], sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """One row for each cell, a column name_s{sigma} for each field and sigma."""
    aggregates = [F.max(F.when(F.col("sigma_um") == s, F.col(c))).alias(f"{c}_s{int(s)}") for s in sigmas for c in columns]
    return fields.groupBy(*CELL).agg(*aggregates)
