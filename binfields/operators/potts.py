"""Potts smoothing of labels over the lattice: energies, neighbour votes, runs with several starts, choice of the weight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.functions.ranks import adjusted_rand
from binfields.functions.summary import global_quantile
from binfields.operators.baseline import SEED, shared_hash, unit_hash
from binfields.operators.grid import CELL
from binfields.operators.smoothing import TILE_BINS, TileRuns, pair_tables
from binfields.sources.scratch import checkpoint


def unary_energy(cells: DataFrame, posterior: str = "posterior", confidence: str = "confidence_weight") -> DataFrame:
    """Adds unary, the confidence-weighted -ln(p) of each label (towards the row mean at low confidence), and label_raw, its argmin."""
    cost = F.transform(posterior, lambda p: -F.log(p + 1e-12))
    total = F.aggregate("_cost", F.lit(0.0), lambda s, x: s + x)
    weight = F.coalesce(F.col(confidence), F.lit(0.5))
    own = cells.withColumn("_cost", cost).withColumn("_mean", total / F.size("_cost")).withColumn("_conf", F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)))
    made = own.withColumn("unary", F.transform("_cost", lambda x: F.col("_conf") * x + (1 - F.col("_conf")) * F.col("_mean")))
    return made.withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int")).drop("_cost", "_mean", "_conf")


def unary_margin(cells: DataFrame, unary: str = "unary") -> DataFrame:
    """One row, lambda0: median of the positive gaps between the two smallest energies."""
    ordered = F.array_sort(unary)
    gap = F.when(F.size(unary) >= 2, ordered[1] - ordered[0]).otherwise(1.0)
    middle = global_quantile(cells.select(gap.alias("g")).filter("g > 0"), "g", 0.5, "lambda0")
    return middle.select(F.greatest(F.coalesce("lambda0", F.lit(1.0)), F.lit(1e-6)).alias("lambda0"))


def _ends(edges: DataFrame, labels: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    left = labels.select(*keys, *CELL, F.col(label).alias("_a"))
    right = labels.select(*keys, F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), F.col(label).alias("_b"))
    return edges.join(left, [*_keys_of(edges, keys), *CELL]).join(right, [*keys, "nx", "ny"])


def _keys_of(edges: DataFrame, keys: Sequence[str]) -> list[str]:
    """Those keys that tell edges apart as well."""
    return [k for k in keys if k in edges.columns]


def boundary_ratio(edges: DataFrame, labels: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Edge weight between different labels over all edge weight."""
    ends = _ends(edges, labels, label, keys)
    return ends.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("_a") != F.col("_b"), F.col("w")).otherwise(0.0)), F.greatest(F.sum("w"), F.lit(1e-12))).alias("boundary_ratio"))


def potts_energy(edges: DataFrame, cells: DataFrame, lam: float | str, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Data, smooth and total energy, in one row or one for each of the ``keys``; ``lam`` is a weight or the key that holds it."""
    data = cells.groupBy(*keys).agg(F.sum(F.element_at("unary", F.col(label) + 1)).alias("data_energy"))
    cut = _ends(edges, cells, label, keys).groupBy(*keys).agg(F.sum(F.when(F.col("_a") != F.col("_b"), F.col("w")).otherwise(0.0)).alias("_cut"))
    joined = data.join(cut, list(keys), "left") if keys else data.join(F.broadcast(cut))
    smooth = F.coalesce("_cut", F.lit(0.0)) * (F.col(lam) if isinstance(lam, str) else F.lit(lam))
    return joined.withColumn("smooth_energy", smooth).drop("_cut").withColumn("total_energy", F.col("data_energy") + F.col("smooth_energy"))


def doubled(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each edge from both ends."""
    own = _keys_of(edges, keys)
    back = edges.select(*own, F.col("nx").alias("x_bin"), F.col("ny").alias("y_bin"), F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), "w")
    return edges.select(*own, *CELL, "nx", "ny", "w").unionByName(back)


def _votes(both: DataFrame, cells: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weight of each cell's neighbours by label, as a map, and in all."""
    right = cells.select(*keys, F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), F.col(label).alias("_l"))
    by_label = both.join(right, [*_keys_of(both, keys), "nx", "ny"]).groupBy(*keys, *CELL, "_l").agg(F.sum("w").alias("_w"))
    return by_label.groupBy(*keys, *CELL).agg(F.map_from_entries(F.collect_list(F.struct("_l", "_w"))).alias("_votes"), F.sum("_w").alias("_all"))


def _penalized(lam: Column) -> Column:
    """Energy of each label of a cell given its neighbours' votes."""
    return F.transform("unary", lambda u, k: u + lam * (F.coalesce("_all", F.lit(0.0)) - F.coalesce(F.try_element_at("_votes", k.cast("int")), F.lit(0.0))))


def _solved(cells: DataFrame, edges: DataFrame, labels: Column, weights: Mapping[tuple, Sequence[float]], sweeps: int, keys: Sequence[str], tile_bins: int) -> TileRuns:
    """Runs that begin with ``labels``, an array with one label for each run."""
    state = TileRuns(cells.select(*keys, *CELL, "unary", labels.alias("labels")), edges, weights, keys=keys, edge_keys=_keys_of(edges, keys), tile_bins=tile_bins)
    return state.run(sweeps)


def potts_icm(cells: DataFrame, edges: DataFrame, lam: float, *, label: str = "label_raw", sweeps: int = 10, tile_bins: int = TILE_BINS) -> DataFrame:
    """Adds label: each cell takes the label of least energy given its neighbours, until nothing changes (see ``smoothing``)."""
    state = _solved(cells, edges, F.array(F.col(label)), {(): [lam]}, sweeps, (), tile_bins)
    return cells.drop("label").join(state.cells().select(*CELL, F.col("labels")[0].alias("label")), list(CELL))


def label_costs(cells: DataFrame, edges: DataFrame, lam: float, label: str = "label") -> DataFrame:
    """x_bin, y_bin, label, cost: energy of each label a cell could take, the labels of its neighbours given."""
    costed = cells.join(_votes(doubled(edges), cells, label), list(CELL), "left")
    return costed.select(*CELL, F.col(label).alias("label"), _penalized(F.lit(lam)).alias("cost"))


def _weights(cells: DataFrame, lams: Sequence[float] | str, keys: Sequence[str]) -> dict[tuple, list[float]]:
    """Weights by key values: one list for all, or a column that holds the list of each key value."""
    if not isinstance(lams, str):
        every = cells.select(*keys).distinct().collect() if keys else [()]  # keys are few: scales
        return {tuple(r): [float(v) for v in lams] for r in every}
    return {tuple(r)[:-1]: [float(v) for v in r[lams]] for r in cells.select(*keys, lams).distinct().collect()}


def _start_labels(n: int, seed: int, run: Column | int = 0) -> list[Column]:
    """The label of least own energy for the first start; in the others a hashed half of the cells begins with a random label."""
    out = [F.col("label_raw").cast("int")]
    for start in range(1, n):
        here = (F.lit(run) if isinstance(run, int) else run) * 100 + start
        other = F.floor(unit_hash(here + seed + 1000, *CELL) * F.size("unary")).cast("int")
        out.append(F.when(unit_hash(here + seed, *CELL) < 0.5, other).otherwise(F.col("label_raw").cast("int")))
    return out


def _best_runs(state: TileRuns, weights: Mapping[tuple, Sequence[float]], starts: int) -> dict[tuple, list[int]]:
    """For each group of ``starts`` consecutive runs the one of least energy (the earlier one on a tie), by key values."""
    energy: dict[tuple, dict[int, float]] = {}
    for r in state.energies().collect():  # a row for each run
        key = tuple(r[k] for k in state.keys)
        energy.setdefault(key, {})[r["run"]] = r["data_energy"] + weights[key][r["run"]] * r["cut"]
    return {key: [min(range(g, g + starts), key=lambda n: (own[n], n)) for g in range(0, len(own), starts)] for key, own in energy.items()}


def smoothed(cells: DataFrame, edges: DataFrame, lams: Sequence[float] | str, *, starts: int = 6, sweeps: int = 10, seed: int = SEED + 500, keys: Sequence[str] = (), tile_bins: int = TILE_BINS) -> DataFrame:
    """lambda, the columns of ``cells``, and label: for each weight the labels of least energy of several starts.

    The first start has the labels of least own energy; in the others a hashed half of the cells begins with a random
    label. All weights and starts are runs of the same tiles; ties go to the earlier start. ``lams`` is a list, or a column
    with an array; ``keys`` tell further lattices apart.
    """
    cells = checkpoint(cells)
    own = _weights(cells, lams, keys)
    runs = {key: [v for v in values for _ in range(starts)] for key, values in own.items()}
    # every weight has the same starts; lists of the same length for all keys
    n = max(len(v) for v in own.values()) if own else 0
    state = _solved(cells, edges, F.array(*(c for _ in range(n) for c in _start_labels(starts, seed))), runs, sweeps, keys, tile_bins)
    picked = [(*key, float(lam), run) for key, best in _best_runs(state, runs, starts).items() for lam, run in zip(own[key], best, strict=True)]
    schema = T.StructType([*(cells.schema[k] for k in keys), T.StructField("lambda", T.DoubleType()), T.StructField("_run", T.IntegerType())])
    best = F.broadcast(cells.sparkSession.createDataFrame(picked, schema))  # one row for each weight
    labels = state.cells()
    chosen = (labels.join(best, list(keys)) if keys else labels.join(best)).select(*keys, "lambda", *CELL, F.element_at("labels", F.col("_run") + 1).alias("label"))
    return checkpoint(cells.drop("label", *([lams] if isinstance(lams, str) else [])).join(chosen, [*keys, *CELL]))


def pseudo_likelihood(cells: DataFrame, edges: DataFrame, lam: float | str, *, label: str = "label", most: int | None = 60_000, seed: int = SEED + 71, keys: Sequence[str] = ()) -> DataFrame:
    """Mean log probability of each cell's label given its neighbours, in one row or one for each of the ``keys``.

    On ``most`` cells at most (a limit of the statistic, as in the reference; None: all cells).
    """
    some = cells
    if most is not None:
        chosen = cells.select(*CELL).distinct().orderBy(F.xxhash64(F.lit(seed), *CELL), *CELL).limit(most)
        some = cells.join(chosen, list(CELL), "left_semi")
    weight = F.col(lam) if isinstance(lam, str) else F.lit(lam)
    costed = some.join(_votes(doubled(edges, keys), cells, label, keys), [*keys, *CELL], "left").withColumn("_cost", _penalized(weight))
    top = -F.array_min("_cost")
    total = F.aggregate("_cost", F.lit(0.0), lambda s, e: s + F.exp(-e - top))
    return costed.groupBy(*keys).agg(F.avg(-F.element_at("_cost", F.col(label) + 1) - (top + F.log(total))).alias("pseudo_likelihood"))


def induced_subgraph(edges: DataFrame, share: float, run: int, seed: int = SEED) -> DataFrame:
    """Edges with both ends in the hashed subsample of a run: a condition on each end, no join."""
    return edges.filter((shared_hash(seed + run, "x_bin", "y_bin") < share) & (shared_hash(seed + run, "nx", "ny") < share))


def subsample(cells: DataFrame, share: float, run: int, seed: int = SEED) -> DataFrame:
    return cells.filter(shared_hash(seed + run, *CELL) < share)


def lambda_stability(cells: DataFrame, edges: DataFrame, lams: Sequence[float] | str, *, repeats: int = 20, share: float = 0.8, starts: int = 2, sweeps: int = 8, seed: int = SEED + 9000, keys: Sequence[str] = (), tile_bins: int = TILE_BINS) -> DataFrame:
    """lambda, stability: mean pairwise adjusted Rand index of solutions on subgraphs, where they overlap.

    A subgraph has the edges between its cells. Runs of all weights are runs of the same tiles; of the starts of a
    subgraph the one of least energy counts.
    """
    cells = checkpoint(cells)
    own = _weights(cells, lams, keys)
    runs = {key: [v for v in values for _ in range(repeats * starts)] for key, values in own.items()}
    n = max(len(v) for v in own.values()) if own else 0
    begun = [F.when(shared_hash(seed + r, *CELL) < share, c).otherwise(-1) for r in range(repeats) for c in _start_labels(starts, seed + 500, r)]
    # made once for all weights
    once = checkpoint(cells.select(*keys, *CELL, "unary", F.array(*begun).alias("_begun")))
    state = _solved(once, edges, F.flatten(F.array_repeat("_begun", n)), runs, sweeps, keys, tile_bins)
    best = _best_runs(state, runs, starts)
    groups = {key: [best[key][g * repeats : (g + 1) * repeats] for g in range(len(values))] for key, values in own.items() if key in best}
    k = once.agg(F.max(F.size("unary")).alias("k")).first()["k"]
    pairs = pair_tables(state.cells(), keys, groups, k or 1)
    scored = adjusted_rand(pairs, "a", "b", [*keys, "group", "pair"], n="n").groupBy(*keys, "group").agg(F.avg("ari").alias("stability"))
    named = [(*key, g, float(lam)) for key, values in own.items() for g, lam in enumerate(values)]
    schema = T.StructType([*(cells.schema[c] for c in keys), T.StructField("group", T.IntegerType()), T.StructField("lambda", T.DoubleType())])
    return F.broadcast(cells.sparkSession.createDataFrame(named, schema)).join(scored, [*keys, "group"]).select(*keys, "lambda", "stability")


def select_lambda(table: DataFrame, mode: str = "stability", manual: float | None = None) -> DataFrame:
    """Of a table (lambda, boundary_ratio, pseudo_likelihood, stability): one row with the chosen lambda."""
    if mode == "manual" and manual is not None:
        return table.limit(1).select(F.lit(float(manual)).alias("lambda"))
    if mode == "pseudolikelihood":
        return table.orderBy(F.desc_nulls_last("pseudo_likelihood"), "lambda").limit(1).select("lambda")
    before = F.col("pseudo_likelihood") - 0.1 * F.col("boundary_ratio")
    objective = F.col("stability") - 0.1 * F.col("boundary_ratio")
    return table.orderBy(F.desc_nulls_last(objective), F.desc_nulls_last(before), "lambda").limit(1).select("lambda")


def cell_energies(cells: DataFrame, edges: DataFrame, lam: float, label: str = "label") -> DataFrame:
    """Adds data_energy, smooth_energy (half of each cut edge to both ends) and total_energy."""
    ends = _ends(edges, cells, label).withColumn("_cut", F.when(F.col("_a") != F.col("_b"), 0.5 * lam * F.col("w")).otherwise(0.0))
    halves = ends.select(*CELL, "_cut").unionByName(ends.select(F.col("nx").alias("x_bin"), F.col("ny").alias("y_bin"), "_cut")).groupBy(*CELL).agg(F.sum("_cut").alias("smooth_energy"))
    out = cells.join(halves, list(CELL), "left").na.fill({"smooth_energy": 0.0}).withColumn("data_energy", F.element_at("unary", F.col(label) + 1))
    return out.withColumn("total_energy", F.col("data_energy") + F.col("smooth_energy"))


def labels_writeback(cells: DataFrame, labelled: DataFrame, columns: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Labels back to all cells: -1 and nulls where a cell has none."""
    own = labelled.select(*CELL, label, *columns)
    return cells.join(own, list(CELL), "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def dominant(rows: DataFrame, groups: Sequence[str], name: str, score: str, ordinal: str) -> DataFrame:
    """Per group the name with the highest score; the first one wins ties."""
    return rows.groupBy(*groups).agg(F.max_by(name, F.struct(F.col(score), -F.col(ordinal))).alias(f"dominant_{name}"))


def top_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(name) <= n)
