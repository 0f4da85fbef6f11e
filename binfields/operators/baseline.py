"""Baseline surface z ~ (x, y): fit region, robust fits, residuals, spatial autocorrelation of what is left."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binfields.functions.scalar import normal_sf
from binfields.functions.summary import global_quantile, median_mad
from binfields.operators.grid import CELL
from binfields.operators.neighbors import knn_join
from binfields.sources.scratch import checkpoint

SEED = 412


def unit_hash(seed: int | Column, *columns: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only, not on partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed.cast("int"), *columns), F.lit(2**52)).cast("double") + 0.5) / 2.0**52


def shared_hash(seed: int, *columns: str) -> Column:
    """Like ``unit_hash``, from 52 bits of the md5 of seed and key, which other SQL engines have too."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def uniform_subsample(cells: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement."""
    return cells.orderBy(shared_hash(seed, *CELL), *CELL).limit(n)


def weighted_subsample(cells: DataFrame, n: int, weight: str = "transcript_count", seed: int = SEED) -> DataFrame:
    """n rows without replacement, likelier with more weight (Efraimidis and Spirakis: the n smallest -ln(u) / w)."""
    return cells.filter(F.col(weight) > 0).orderBy(-F.log(shared_hash(seed, *CELL)) / F.col(weight), *CELL).limit(n)


def fit_region(density: DataFrame, *, column: str = "rho", q: float = 0.6, least: int = 50, most_added: int = 5000) -> DataFrame:
    """Cells with pilot density at or above the q quantile; if those are too few, the densest cells as well."""
    limit = global_quantile(density, column, q, "_limit")
    inside = density.join(F.broadcast(limit)).filter(F.col(column) >= F.col("_limit")).drop("_limit")
    if inside.count() >= least:
        return inside
    return inside.unionByName(density.orderBy(F.desc(column), *CELL).limit(most_added)).distinct()


def _terms(order: str) -> list[Column]:
    x, y = F.col("_x"), F.col("_y")
    return [x, y] if order == "linear" else [x, y, x * x, x * y, y * y]


def _hashed_candidates(rows: DataFrame, columns: int, n: int, seed: int) -> list[np.ndarray]:
    """Least-squares planes through small hashed samples, from sums that one pass makes for all candidates."""
    arms = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(unit_hash(seed, "_c", *CELL) < 0.2)
    basis = [F.lit(1.0), *(F.col(f"_f{k}") for k in range(columns))]
    sums = [F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(basis) for j, b in enumerate(basis) if j >= i] + [F.sum(a * F.col("_z")).alias(f"v{i}") for i, a in enumerate(basis)]
    out = []
    for row in arms.groupBy("_c").agg(*sums).orderBy("_c").collect():  # n rows of a few sums
        m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(columns + 1)] for i in range(columns + 1)])
        out.append(np.linalg.lstsq(m, np.array([row[f"v{i}"] for i in range(columns + 1)]), rcond=None)[0])
    return out


def _plane(coefficients: np.ndarray) -> Column:
    out = F.lit(float(coefficients[0]))
    for k, c in enumerate(coefficients[1:]):
        out = out + float(c) * F.col(f"_f{k}")
    return out


def baseline_surface(region: DataFrame, order: str = "linear", *, z: str = "z_mean_um", weight: str = "transcript_count", candidates: int = 20, seed: int = SEED) -> dict:
    """A robust weighted surface: order, centre and scale of x and y, coefficients, inlier limit and plane, and AIC.

    Candidate planes come from hashed samples of a fifth of the rows and are all scored in one aggregate; rows within
    1.5 median absolute deviations of the best are inliers, on which a Huber regression (epsilon 1.35) is fitted.
    """
    centre = region.agg(*(f(f"{a}_um").alias(f"{a}_{n}") for a in "xy" for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    scaled = region.withColumns({f"_{a}": (F.col(f"{a}_um") - centre[f"{a}_mean"]) / (centre[f"{a}_std"] or 1.0) for a in "xy"})
    terms = _terms(order)
    rows = scaled.select(*CELL, *(t.alias(f"_f{k}") for k, t in enumerate(terms)), F.col(z).alias("_z"), F.col(weight).cast("double").alias("_w")).filter("_z is not null")
    limit = max(1e-6, 1.5 * (median_mad(rows, "_z").first()["mad"] or 0.0))
    planes = _hashed_candidates(rows, len(terms), candidates, seed)
    counts = rows.agg(*(F.count_if(F.abs(F.col("_z") - _plane(p)) <= limit).alias(f"c{k}") for k, p in enumerate(planes))).first()
    best = planes[max(range(len(planes)), key=lambda k: (counts[f"c{k}"], -k))]
    inliers = rows.filter(F.abs(F.col("_z") - _plane(best)) <= limit)
    assembled = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(terms))], outputCol="_features").transform(inliers)
    model = LinearRegression(featuresCol="_features", labelCol="_z", weightCol="_w", loss="huber", epsilon=1.35, maxIter=300).fit(assembled)
    fitted = np.array([model.intercept, *model.coefficients.toArray()])
    error = F.col("_z") - _plane(fitted)
    fit = rows.agg(F.sum(F.col("_w") * error * error).alias("rss"), F.avg("_w").alias("w"), F.count("*").alias("n")).first()
    rss, n = fit["rss"] / max(fit["w"], 1e-12), fit["n"]
    aic = 2 * (len(terms) + 1) + n * math.log(max(rss / n, 1e-12))
    return {"order": order, "centre": centre.asDict(), "coefficients": fitted.tolist(), "inlier_plane": best.tolist(), "inlier_limit": limit, "aic": aic}


def choose_surface(linear: dict, quadratic: dict, least_gain: float = 2.0) -> dict:
    return quadratic if quadratic["aic"] <= linear["aic"] - least_gain else linear


def baseline_residual(cells: DataFrame, surface: dict, region: DataFrame, *, z: str = "z_mean_um", weight: str = "transcript_count") -> DataFrame:
    """Adds z_baseline, z_residual, baseline_fit_weight and baseline_inlier."""
    centre = surface["centre"]
    scaled = cells.withColumns({f"_{a}": (F.col(f"{a}_um") - centre[f"{a}_mean"]) / (centre[f"{a}_std"] or 1.0) for a in "xy"})
    made = scaled.select("*", *(t.alias(f"_f{k}") for k, t in enumerate(_terms(surface["order"]))))
    flagged = made.join(region.select(*CELL, F.lit(True).alias("_fit")), list(CELL), "left")
    near = F.abs(F.col(z) - _plane(np.array(surface["inlier_plane"]))) <= surface["inlier_limit"]
    out = flagged.withColumn("z_baseline", _plane(np.array(surface["coefficients"])))
    out = out.withColumn("z_residual", F.col(z) - F.col("z_baseline"))
    out = out.withColumn("baseline_fit_weight", F.when(F.col("_fit"), F.col(weight).cast("double")).otherwise(0.0))
    out = out.withColumn("baseline_inlier", F.when(F.col("_fit") & near, 1).otherwise(0))
    return out.drop("_x", "_y", "_fit", *(f"_f{k}" for k in range(5)))


def morans_i(cells: DataFrame, value: str, *, k: int = 8, most: int | None = 25_000) -> DataFrame:
    """One row: moran_i over the k nearest neighbours with equal weights; beyond ``most`` cells on a weighted subsample (a documented limit of the statistic; None: all cells)."""
    rows = cells.filter(F.col(value).isNotNull())
    if most is not None and rows.count() > most:
        rows = weighted_subsample(rows, most)
    mean = rows.agg(F.avg(value).alias("_m"))
    centred = rows.join(F.broadcast(mean)).select(*CELL, (F.col(value) - F.col("_m")).alias("_z"))
    near = knn_join(centred, k).select(*CELL, "nx", "ny")
    right = centred.select(F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), F.col("_z").alias("_zn"))
    products = near.join(centred, list(CELL)).join(right, ["nx", "ny"]).groupBy(*CELL).agg(F.avg(F.col("_z") * F.col("_zn")).alias("_p"))
    return products.agg(F.sum("_p").alias("_top")).join(F.broadcast(centred.agg(F.sum(F.col("_z") * F.col("_z")).alias("_den")))).select(F.try_divide("_top", "_den").alias("moran_i"))


def moran_moments(cells: DataFrame, value: str, *, k: int = 8) -> DataFrame:
    """One row: moran_i over all cells, and its exact mean and variance over all permutations of the values.

    The moments need only sums of powers of the values and of the weights, so any number of cells is one pass over the
    table and one over the links to the k nearest. Null below four cells or without spread.
    """
    rows = cells.filter(F.col(value).isNotNull())
    centred = checkpoint(rows.join(F.broadcast(rows.agg(F.avg(value).alias("_m")))).select(*CELL, (F.col(value) - F.col("_m")).alias("_z")))
    near = knn_join(centred, k).select(*CELL, "nx", "ny")
    weighted = checkpoint(near.join(near.groupBy(*CELL).agg((1 / F.count("*")).alias("_w")), list(CELL)))
    here, there = F.struct(*CELL), F.struct(F.col("nx").alias("x_bin"), F.col("ny").alias("y_bin"))
    both = weighted.groupBy(F.least(here, there).alias("_a"), F.greatest(here, there).alias("_b")).agg(F.sum("_w").alias("_t"))
    into = weighted.groupBy(F.col("nx").alias("x_bin"), F.col("ny").alias("y_bin")).agg(F.sum("_w").alias("_in"))
    right = centred.select(F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), F.col("_z").alias("_zn"))
    top = weighted.join(centred, list(CELL)).join(right, ["nx", "ny"]).agg(F.sum(F.col("_w") * F.col("_z") * F.col("_zn")).alias("top"), F.sum("_w").alias("s0"))
    square = F.col("_z") * F.col("_z")
    out = 1 + F.coalesce("_in", F.lit(0.0))
    one = [top, both.agg(F.sum(F.col("_t") * F.col("_t")).alias("s1")), centred.join(into, list(CELL), "left").agg(F.count("*").cast("double").alias("n"), F.sum(square).alias("z2"), F.sum(square * square).alias("z4"), F.sum(out * out).alias("s2"))]
    row = one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # one row each
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    kurtosis = F.try_divide(n * F.col("z4"), F.col("z2") * F.col("z2"))
    mean = F.try_divide(F.lit(-1.0), n - 1)
    upper = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - kurtosis * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    squared = F.try_divide(upper, (n - 1) * (n - 2) * (n - 3) * s0 * s0)
    i = F.try_divide(n * F.col("top"), s0 * F.col("z2"))
    return row.select(i.alias("moran_i"), mean.alias("mean"), F.when(n >= 4, squared - mean * mean).alias("variance"))


def moran_p(cells: DataFrame, value: str, *, k: int = 8, most: int | None = 25_000, permutations: int = 999, seed: int = SEED + 17) -> float:
    """Permutation p of Moran's I, (1 + #{|permuted| >= |observed|}) / (n + 1): permutations run in parallel over the capped table of ``most`` cells.

    With ``most`` None all cells count: the share of permutations beyond is that of a normal distribution with the exact
    permutation mean and variance (``moran_moments``), which differs from it by something like 1 / sqrt(cells).
    """
    rows = cells.filter(F.col(value).isNotNull())
    if most is None:
        one = moran_moments(rows, value, k=k)
        far, spread = F.abs("moran_i"), F.sqrt("variance")
        beyond = normal_sf((far - F.col("mean")) / spread) + normal_sf((far + F.col("mean")) / spread)
        share = one.select(F.when(F.col("variance") > 0, beyond).alias("p")).first()["p"]
        return (1 + permutations * (1.0 if share is None else min(share, 1.0))) / (permutations + 1)
    if rows.count() > most:
        rows = weighted_subsample(rows, most)
    near = knn_join(rows, k).select(*CELL, "nx", "ny")
    table = rows.select(*CELL, F.col(value).alias("v")).orderBy(*CELL).toPandas()  # ``most`` rows
    place = {(x, y): n for n, (x, y) in enumerate(zip(table.x_bin, table.y_bin, strict=True))}
    pairs = near.toPandas()
    i = np.array([place[c] for c in zip(pairs.x_bin, pairs.y_bin, strict=True)], int)
    j = np.array([place[c] for c in zip(pairs.nx, pairs.ny, strict=True)], int)
    z = table.v.to_numpy(float) - table.v.mean()
    share = 1.0 / np.bincount(i, minlength=len(z))[i] if len(i) else np.zeros(0)
    shared = cells.sparkSession.sparkContext.broadcast((z, i, j, share))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, i, j, share = shared.value
        for batch in batches:
            out = []
            for n in batch.id:
                moved = z[np.random.default_rng(seed + int(n)).permutation(len(z))]
                out.append(abs(float((moved[i] * moved[j] * share).sum())))
            yield pd.DataFrame({"size": out})

    seen = abs(float((z[i] * z[j] * share).sum()))
    beyond = cells.sparkSession.range(permutations).mapInPandas(permute, "size double").filter(F.col("size") >= seen).count()
    return (1 + beyond) / (permutations + 1)


# The p and the size of Moran's I from which a trend counts.
def trend_remains(i: float | None, p: float | None) -> bool:
    return i is not None and p is not None and p < 0.01 and abs(i) >= 0.03


def trend_guard(cells: DataFrame, trend: bool, *, residual: str = "z_residual", q: float = 0.75, down: float = 0.7) -> DataFrame:
    """Adds local_scale: lower confidence where a remaining trend leaves large residuals."""
    if not trend:
        return cells.withColumn("local_scale", F.lit(1.0))
    limit = global_quantile(cells.select(F.abs(residual).alias("_size")), "_size", q, "_limit")
    return cells.join(F.broadcast(limit)).withColumn("local_scale", F.when(F.abs(residual) >= F.col("_limit"), down).otherwise(1.0)).drop("_limit")
