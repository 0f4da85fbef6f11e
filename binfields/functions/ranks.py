"""Rank statistics without a dense matrix: midranks, rank tests, correlations, false discovery, global ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.functions.scalar import normal_sf
from binfields.sources.scratch import checkpoint


def running_sum(rows: DataFrame, order: Sequence[Column | str], n: str, groups: Sequence[str] = (), name: str = "below") -> DataFrame:
    """Adds the sum of ``n`` over the rows of the group that come before in the order, without a group in one task.

    Rows are dealt by range of groups and order and written once; sums run within a partition, and those of the partitions
    before it are added: one number for each partition and group in it, groups cut by a border being at most as many as
    partitions.
    """
    # the partition number is written with the row: a second evaluation of the shuffle could draw other borders
    dealt = checkpoint(rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_local", F.coalesce(F.sum(n).over(local), F.lit(0)))
    if not groups:
        sizes = dealt.groupBy("_part").agg(F.sum(n).alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        return summed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")
    sizes = dealt.groupBy(*groups, "_part").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.sum("_n").over(before)).filter("_start is not null").drop("_n")
    # a group has a start only where it goes on from the partition before, so a partition has one such group at most
    joined = join_null_safe(summed, F.broadcast(starts), [*groups, "_part"], "left")
    return joined.select(*rows.columns, (F.coalesce("_start", F.lit(0)) + F.col("_local")).alias(name))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the left side's keys stay."""
    names = {k: f"_right_{n}" for n, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for k, n in names.items():
        condition = condition & F.col(k).eqNullSafe(F.col(n))
    return left.join(renamed, condition, how).drop(*names.values())


#: Rows of a few numbers each that are broadcast.
_FEW = 100_000


def _few(totals: DataFrame) -> DataFrame:
    """One row for each group: broadcast if they are few, so that a few large groups do not meet in as few tasks."""
    return F.broadcast(totals) if totals.limit(_FEW + 1).count() <= _FEW else totals


def midranks(rows: DataFrame, values: Mapping[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """Adds under each name the average rank of its value (nulls get none). Ties are counted first, so sums run over different values only."""
    # ranks come back by value, so the rows are written once: a mean evaluated again may differ in its last bits and would miss its rank
    written = out = checkpoint(rows)
    for name, value in values.items():
        counted = written.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
        ranked = running_sum(counted, [value], "_n", groups, "_below")
        ranked = ranked.select(*groups, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
        out = join_null_safe(out, ranked, [*groups, value], "left")
    return out


def midrank(rows: DataFrame, value: str, groups: Sequence[str] = (), name: str = "midrank") -> DataFrame:
    """``midranks`` of one value."""
    return midranks(rows, {name: value}, groups)


def order_statistics(rows: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """groups, and q0, q1, ..: exact quantiles with linear interpolation, nulls and NaN left out; no group meets in one task."""
    counted = rows.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*groups, "_v").agg(F.count("*").alias("_n"))
    placed = checkpoint(running_sum(counted, ["_v"], "_n", groups, "_below"))
    totals = placed.groupBy(*groups).agg(F.max(F.col("_below") + F.col("_n")).alias("_total"))
    joined = join_null_safe(placed, _few(totals), groups) if groups else placed.join(F.broadcast(totals))
    parts = []
    for k, q in enumerate(qs):
        at = (F.col("_total") - 1) * F.lit(float(q))
        for name, place in ((f"_l{k}", F.floor(at)), (f"_h{k}", F.ceil(at))):
            parts.append(F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_v"))).alias(name))
        parts.append(F.max(at - F.floor(at)).alias(f"_f{k}"))
    found = joined.groupBy(*groups).agg(*parts)
    return found.select(*groups, *((F.col(f"_l{k}") + F.when(F.col(f"_f{k}") > 0, (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).otherwise(0.0)).alias(f"q{k}") for k in range(len(qs))))


def rank_sums(values: DataFrame, sizes: DataFrame, label: str, *, item: str = "feature_name", value: str = "cpm", most_in_window: int = 100_000) -> DataFrame:
    """item, label, n1, n2, u, ties: Mann-Whitney U of each label against all others, from sparse non-negative values.

    ``values`` has (item, label, value) for non-zero values only; ``sizes`` has (label, n_cells). The zeros of an item are
    one block of ties that ranks first, so they are never materialised, and one pass serves all labels. Items with
    more than ``most_in_window`` different values are ranked by range, not in one task each.
    """
    nonzero = values.filter(F.col(value) > 0).groupBy(item, label, value).agg(F.count("*").alias("n"))
    grid = values.select(item).distinct().join(F.broadcast(sizes))  # labels are few
    seen = nonzero.groupBy(item, label).agg(F.sum("n").alias("nnz"))
    zeros = grid.join(seen, [item, label], "left").select(item, label, F.lit(0.0).alias(value), (F.col("n_cells") - F.coalesce("nnz", F.lit(0))).alias("n"))
    every = nonzero.unionByName(zeros.filter("n > 0"))
    by_value = checkpoint(every.groupBy(item, value).agg(F.sum("n").alias("t")))
    largest = by_value.groupBy(item).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    if largest <= most_in_window:
        earlier = Window.partitionBy(item).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        below = by_value.withColumn("_below", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    else:
        below = running_sum(by_value, [value], "t", [item], "_below")
    ranked = below.withColumn("rank", F.col("_below") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    ties = by_value.groupBy(item).agg(F.sum(t * t * t - t).alias("ties"), F.sum("t").alias("total"))
    sums = every.join(ranked, [item, value]).groupBy(item, label).agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n1"))
    out = sums.join(ties, item)
    n1 = F.col("n1").cast("double")
    return out.select(item, label, "n1", (F.col("total") - F.col("n1")).alias("n2"), (F.col("r") - n1 * (n1 + 1) / 2).alias("u"), "ties")


def rank_test(sums: DataFrame) -> DataFrame:
    """Adds z (with continuity correction, tie-corrected), pval (two-sided) and score, the rank-biserial correlation.

    All values equal: z 0 and pval 1.
    """
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    bigger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    z = F.when(variance > 0, (bigger - n1 * n2 / 2 - 0.5) / F.sqrt(variance)).otherwise(0.0)
    scored = sums.withColumn("z", z).withColumn("score", (F.try_divide(F.col("u"), n1 * n2) - 0.5) * 2)
    return scored.withColumn("pval", F.when(variance > 0, F.least(2 * normal_sf("z"), F.lit(1.0))).otherwise(1.0))


def bh_fdr(rows: DataFrame, p: str, groups: Sequence[str] = (), name: str = "qval") -> DataFrame:
    """Benjamini-Hochberg q values within groups; a null p counts as 1. Rows number in thousands (genes, terms), not cells."""
    filled = F.coalesce(F.col(p), F.lit(1.0))
    by = Window.partitionBy(*groups)
    ranked = rows.withColumn("_p", filled).withColumn("_rank", F.row_number().over(by.orderBy("_p"))).withColumn("_m", F.count("*").over(by))
    far_end = by.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(far_end), F.lit(1.0))).drop("_p", "_rank", "_m")


def spearman(rows: DataFrame, x: str, y: str, groups: Sequence[str], *, least: int = 20, name: str = "rho") -> DataFrame:
    """Spearman correlation per group; fewer than ``least`` complete rows give null."""
    complete = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midranks(complete.select(*dict.fromkeys([*groups, x, y])), {"_rx": x, "_ry": y}, groups)
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("_rx", "_ry")).alias(name))


def partial_spearman(rows: DataFrame, x: str, y: str, covariate: str, groups: Sequence[str], *, least: int = 20, name: str = "partial_rho") -> DataFrame:
    """Ranks of x and y lose their linear part in the covariate's ranks; the residuals' Spearman correlation."""
    complete = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(covariate).isNotNull())
    ranked = checkpoint(midranks(complete.select(*groups, x, y, covariate), {"_rx": x, "_ry": y, "_rc": covariate}, groups))
    fits = [f for r in ("_rx", "_ry") for f in (F.coalesce(F.regr_slope(r, "_rc"), F.lit(0.0)).alias(f"{r}_slope"), F.avg(r).alias(f"{r}_mean"))]
    lines = ranked.groupBy(*groups).agg(F.avg("_rc").alias("_rc_mean"), *fits)
    ranked = ranked.join(F.broadcast(lines), list(groups))  # one row for each group, of which there are few
    for rank in ("_rx", "_ry"):
        fit = F.col(f"{rank}_slope") * (F.col("_rc") - F.col("_rc_mean")) + F.col(f"{rank}_mean")
        ranked = ranked.withColumn(f"{rank}_left", F.round(F.col(rank) - fit, 9))
    again = midranks(ranked.select(*groups, "_rx_left", "_ry_left"), {"_a": "_rx_left", "_b": "_ry_left"}, groups)
    return again.groupBy(*groups).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("_a", "_b")).alias(name))


def adjusted_rand(rows: DataFrame, a: str, b: str, groups: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows: the pair table is all that is aggregated. ``n``: how many rows a row counts for."""
    cells = rows.groupBy(*groups, a, b).agg((F.count("*") if n is None else F.sum(n)).alias("n"))

    def pairs(x):
        return F.sum(x * (x - 1) / 2)

    both = cells.groupBy(*groups).agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("total"))
    by_a = cells.groupBy(*groups, a).agg(F.sum("n").alias("n")).groupBy(*groups).agg(pairs(F.col("n")).alias("in_a"))
    by_b = cells.groupBy(*groups, b).agg(F.sum("n").alias("n")).groupBy(*groups).agg(pairs(F.col("n")).alias("in_b"))
    joined = both.join(by_a, list(groups)).join(by_b, list(groups)) if groups else both.join(F.broadcast(by_a)).join(F.broadcast(by_b))
    every = F.col("total") * (F.col("total") - 1) / 2
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), every)
    top = (F.col("in_a") + F.col("in_b")) / 2
    return joined.select(*groups, F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0)).alias("ari"))


def global_rank(rows: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 1 over all rows."""
    summed = running_sum(rows.withColumn("_one", F.lit(1)), order, "_one", (), name)
    return summed.withColumn(name, F.col(name) + 1).drop("_one")


def weighted_quantile(rows: DataFrame, value: str, weight: str, groups: Sequence[str], q: float, name: str) -> DataFrame:
    """The smallest value whose cumulative weight reaches q times the total; no interpolation."""
    by_value = rows.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    summed = checkpoint(running_sum(by_value, [value], "_w", groups, "_below"))
    reached = F.col("_below") + F.col("_w")
    if not groups:
        totals = summed.agg(F.sum("_w").alias("_total"))
        return summed.join(F.broadcast(totals)).filter(reached >= q * F.col("_total")).agg(F.min(value).alias(name))
    totals = summed.groupBy(*groups).agg(F.sum("_w").alias("_total"))
    return summed.join(_few(totals), list(groups)).filter(reached >= q * F.col("_total")).groupBy(*groups).agg(F.min(value).alias(name))
