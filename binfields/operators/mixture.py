"""Diagonal Gaussian mixtures by EM: many fits advance in one pass over the cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfields.functions.ranks import adjusted_rand
from binfields.operators.baseline import SEED, unit_hash
from binfields.operators.grid import CELL, finite_rows
from binfields.operators.smoothing import pair_tables

FLOOR = 1e-6


def standardize(rows: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Finite rows with ``features``: columns as z-scores with population spread (spread 0 counts as 1), by ``keys`` if given."""
    if set(columns) & set(forbidden):
        raise ValueError(f"columns not meant for clustering: {sorted(set(columns) & set(forbidden))}")
    rows = finite_rows(rows, columns)
    moments = rows.groupBy(*keys).agg(*(f(c).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = [(F.col(c) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") > 0, F.col(f"_s{k}")).otherwise(1.0) for k, c in enumerate(columns)]
    drop = [f"_{n}{k}" for k in range(len(columns)) for n in "ms"]
    joined = rows.join(F.broadcast(moments), list(keys)) if keys else rows.join(F.broadcast(moments))  # one row for each key: scales
    return joined.withColumn("features", F.array(*scaled)).drop(*drop)


def _log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    inside = ((x[:, None, :] - means) ** 2 / variances + np.log(2 * np.pi * variances)).sum(2)
    return np.log(weights) - 0.5 * inside


def _posterior(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = joint.max(1, keepdims=True)
    total = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
    return np.exp(joint - total), total[:, 0]


def fit_mixtures(cells: DataFrame, fits: Sequence[tuple], *, rounds: int = 40, tolerance: float = 1e-3, seed: int = SEED, key: str | None = None) -> list[dict]:
    """One mixture for each (k, share of cells); a cell belongs to fit f if its hash for f is below the share.

    ``cells`` has x_bin, y_bin and features. With ``key`` a fit is (k, share, key value) and sees the cells of that value
    only. Each round is one pass that sums the statistics of all fits that still move; what reaches the driver is a few
    numbers for each component. Fits begin with centres from a pool that all cells give (``_pool``).
    """
    n_fits = len(fits)
    values = list(dict.fromkeys(f[2] for f in fits)) if key else [None]
    members = [unit_hash(seed + 1000 + f, *CELL) < fit[1] for f, fit in enumerate(fits)]
    if key:
        members = [m & (F.col(key) == fit[2]) for m, fit in zip(members, fits, strict=True)]
    group = F.lit(0) if not key else F.array_position(F.array(*map(F.lit, values)), F.col(key)).cast("int") - 1
    # cells of other key values would be in no fit
    own = cells.select(*CELL, "features", group.alias("group"), F.array(*members).alias("members")).filter("group >= 0")
    data = own.persist()
    pools = _pool(data, len(values), max(f[0] for f in fits), seed)
    models = [_start(*pools[values.index(fit[2]) if key else 0], fit[0], f) for f, fit in enumerate(fits)]
    moving = set(range(n_fits))
    for _ in range(rounds):
        sums = _sums(data, models, sorted(moving))
        for f in sorted(moving):
            before = models[f]["log_likelihood"]
            models[f] = _maximize(sums[f])
            now = models[f]["log_likelihood"]
            if before is not None and abs(now - before) / max(models[f]["n"], 1) < tolerance:
                moving.discard(f)
        if not moving:
            break
    for f, own in _sums(data, models, list(range(n_fits))).items():
        k, d = models[f]["means"].shape
        n, likelihood, entropy = own["n"], own["log_likelihood"], own["entropy"]
        bic = -2 * likelihood + (2 * k * d + k - 1) * np.log(max(n, 1))
        models[f] |= {"log_likelihood": likelihood, "n": n, "bic": bic, "icl": bic + 2 * entropy}
    data.unpersist()
    return models


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = ((x[:, None, :] - centres) ** 2).sum(2)
    return gap.argmin(1), gap.min(1)


def _pool(data: DataFrame, groups: int, k: int, seed: int, rounds: int = 4) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Centres, their weights and the variance of the features, for each group (key value): k-means|| over all its cells.

    Each round draws about 4 k cells, likelier the farther they are from the pool, by hashes of their bins; at the end
    each cell counts for the nearest of the pool, which has some 16 k cells at most whatever the number of cells.
    """
    width = data.agg(F.max(F.size("features")).alias("w")).first()["w"]
    if not width:
        raise ValueError("no cells to cluster")
    moments = data.groupBy("group").agg(*(f(F.col("features")[j]).alias(f"{n}{j}") for j in range(width) for n, f in (("m", F.avg), ("v", F.var_pop))))
    stats = {r["group"]: (np.array([[r[f"m{j}"] for j in range(width)]]), np.array([r[f"v{j}"] for j in range(width)])) for r in moments.collect()}
    if len(stats) < groups:
        raise ValueError("no cells to cluster")
    # the mean stands in for a first centre, and leaves the pool when there are others
    pool = {g: mean for g, (mean, _) in stats.items()}

    def costs(pool: dict[int, np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x, own = np.stack(batch.features.to_numpy()), batch.group.to_numpy()
                    place, gap = np.zeros(len(x), int), np.zeros(len(x))
                    for g in np.unique(own):
                        place[own == g], gap[own == g] = _nearest(x[own == g], pool[g])
                    yield pd.DataFrame({"x_bin": batch.x_bin, "y_bin": batch.y_bin, "group": own, "features": batch.features, "place": place, "cost": gap})

        return data.select(*CELL, "group", "features").mapInPandas(run, "x_bin int, y_bin int, group int, features array<double>, place int, cost double")

    for r in range(rounds):
        measured = costs(pool)
        total = measured.groupBy("group").agg(F.sum("cost").alias("all"))  # one row for each key value
        chance = F.try_divide(4.0 * k * F.col("cost"), F.col("all"))
        drawn = measured.join(F.broadcast(total), "group").filter(unit_hash(seed + 7000 + r, *CELL, "group") < chance).select("group", "features").collect()
        for g, mean in stats.items():
            more = [row["features"] for row in drawn if row["group"] == g]
            if more:
                known = pool[g] if pool[g] is not mean[0] else np.zeros((0, width))
                pool[g] = np.concatenate([known, np.array(sorted(more), float)])
    weights = {g: np.zeros(len(p)) for g, p in pool.items()}
    for row in costs(pool).groupBy("group", "place").agg(F.count("*").alias("n")).collect():
        weights[row["group"]][row["place"]] = row["n"]
    return [(pool[g], weights[g], stats[g][1]) for g in range(groups)]


def _start(pool: np.ndarray, weights: np.ndarray, variance: np.ndarray, k: int, f: int, tries: int = 6) -> dict:
    """The likeliest of several mixtures of a weighted pool: each begins with a heavy centre and goes on with far ones, with and without their weight."""
    heavy, spread, best = np.argsort(-weights, kind="stable"), np.maximum(variance, 1e-2), None
    for t in range(2 * tries):
        chosen = [int(heavy[(f + t // 2) % len(heavy)])]
        while len(chosen) < k:
            far = ((pool[:, None, :] - pool[chosen]) ** 2).sum(2).min(1)
            chosen.append(int((far * weights if t % 2 else far).argmax()))
        model = {"weights": np.full(k, 1 / k), "means": pool[chosen].copy(), "variances": np.tile(spread, (k, 1))}
        for _ in range(30):
            r, likelihood = _posterior(_log_joint(pool, model["weights"], model["means"], model["variances"]))
            own = r * weights[:, None]
            model = _maximize({"mass": own.sum(0), "first": own.T @ pool, "second": own.T @ pool**2, "log_likelihood": (weights * likelihood).sum(), "n": weights.sum()})
            # points of the pool stand for cells around them
            model["variances"] = np.maximum(model["variances"], 0.05 * spread)
        if best is None or model["log_likelihood"] > best["log_likelihood"]:
            best = model
    return best | {"log_likelihood": None, "n": 0}


def _sums(data: DataFrame, models: list[dict], which: list[int]) -> dict[int, dict]:
    shapes = {f: models[f]["means"].shape for f in which}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {f: np.zeros(3 + k + 2 * k * d) for f, (k, d) in shapes.items()}
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch.features.to_numpy())
            inside = np.stack(batch.members.to_numpy())
            for f in which:
                own = x[inside[:, f]]
                if not len(own):
                    continue
                m = models[f]
                r, likelihood = _posterior(_log_joint(own, m["weights"], m["means"], m["variances"]))
                entropy = -(r * np.log(r + 1e-12)).sum()
                total[f] += np.concatenate([[len(own), likelihood.sum(), entropy], r.sum(0), (r.T @ own).ravel(), (r.T @ own**2).ravel()])
        yield pd.DataFrame([(f, p, v) for f, t in total.items() for p, v in enumerate(t)], columns=["f", "p", "v"])

    out = {f: np.zeros(3 + k + 2 * k * d) for f, (k, d) in shapes.items()}
    for row in data.mapInPandas(partial, "f int, p int, v double").groupBy("f", "p").agg(F.sum("v").alias("v")).collect():
        out[row["f"]][row["p"]] = row["v"]
    made = {}
    for f, t in out.items():
        k, d = shapes[f]
        made[f] = {"n": t[0], "log_likelihood": t[1], "entropy": t[2], "mass": t[3 : 3 + k], "first": t[3 + k : 3 + k + k * d].reshape(k, d), "second": t[3 + k + k * d :].reshape(k, d)}
    return made


def _maximize(sums: dict) -> dict:
    mass = np.maximum(sums["mass"], 1e-10)[:, None]
    means = sums["first"] / mass
    variances = np.maximum(sums["second"] / mass - means**2, 0) + FLOOR
    weights = sums["mass"] + 1e-10
    return {"weights": weights / weights.sum(), "means": means, "variances": variances, "log_likelihood": sums["log_likelihood"], "n": sums["n"]}


def gmm_diag(cells: DataFrame, k: int, *, seed: int = SEED, rounds: int = 40) -> dict:
    """One mixture on all cells: weights, means, variances, log_likelihood, bic, icl."""
    return fit_mixtures(cells, [(k, 1.0)], rounds=rounds, seed=seed)[0]


def posterior(cells: DataFrame, model: dict | dict[object, dict], name: str = "posterior", key: str | None = None) -> DataFrame:
    """Adds the array of component probabilities; with ``key`` there is a model for each of its values."""
    kind = cells.withColumn(name, F.array().cast("array<double>")).schema

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, out = np.stack(batch.features.to_numpy()), [None] * len(batch)
                for value in pd.unique(batch[key]) if key else (None,):
                    m, rows = model[value] if key else model, np.flatnonzero(batch[key].to_numpy() == value) if key else np.arange(len(batch))
                    r, _ = _posterior(_log_joint(x[rows], m["weights"], m["means"], m["variances"]))
                    for n, own in zip(rows, r, strict=True):
                        out[n] = own
                batch[name] = out
                yield batch

    return cells.mapInPandas(assign, kind)


def k_stability(cells: DataFrame, ks: Sequence[int], *, fits: int = 8, share: float = 0.8, rounds: int = 25, seed: int = SEED) -> dict[int, float]:
    """Mean pairwise adjusted Rand index of labels from subsample fits; all fits of all k advance together.

    Tasks add up the tables of label pairs of their own cells, so only counts are shuffled.
    """
    models = fit_mixtures(cells, [(k, share) for k in ks for _ in range(fits)], rounds=rounds, seed=seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.features.to_numpy())
                yield pd.DataFrame({"labels": list(np.stack([_log_joint(x, m["weights"], m["means"], m["variances"]).argmax(1) for m in models], 1).astype(np.int32))})

    labels = cells.select("features").mapInPandas(assign, "labels array<int>")
    groups = {(): [list(range(n * fits, (n + 1) * fits)) for n in range(len(ks))]}
    scored = adjusted_rand(pair_tables(labels, [], groups, max(ks)), "a", "b", ["group", "pair"], n="n")
    return {ks[r["group"]]: r["ari"] for r in scored.groupBy("group").agg(F.avg("ari").alias("ari")).collect()}


def select_k(table: DataFrame, least: float = 0.7) -> DataFrame:
    """Of a table (k, icl, stability): least icl among the stable, else the most stable; ties to the smaller k."""
    stable = F.coalesce(F.col("stability") >= least, F.lit(False))
    return table.orderBy(F.desc(stable), F.when(stable, F.col("icl")).asc_nulls_last(), F.desc_nulls_last("stability"), "k").limit(1)
