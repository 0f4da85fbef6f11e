"""Aggregates: effect sizes, medians, quantiles, confidence bins, weighted spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.functions.ranks import join_null_safe, order_statistics
from binfields.functions.scalar import conf_bins


def cohens_d(x: Column, in_a: Column, in_b: Column) -> Column:
    """Mean difference over the pooled standard deviation; null below two values a side or without spread."""
    a, b = F.when(in_a, x), F.when(in_b, x)
    n1, n2 = F.count(a).cast("double"), F.count(b).cast("double")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b), n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), F.try_divide(F.avg(a) - F.avg(b), pooled))


def global_quantile(rows: DataFrame, value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact, linearly interpolated; null without values."""
    return order_statistics(rows, value, [q]).withColumnRenamed("q0", name)


def median_mad(rows: DataFrame, value: str) -> DataFrame:
    """Median and median absolute deviation."""
    middle = global_quantile(rows, value, 0.5, "median").first()["median"]
    far = rows.select(F.abs(F.col(value) - F.lit(middle)).alias("_far"))
    return global_quantile(far, "_far", 0.5, "mad").select(F.lit(middle).cast("double").alias("median"), "mad")


def group_median(rows: DataFrame, label: str, value: str) -> DataFrame:
    return order_statistics(rows, value, [0.5], [label]).withColumnRenamed("q0", "median")


def relabel_by_median(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """New label ids are ranks of the labels' medians."""
    order = Window.orderBy("median", label)  # one row for each label
    mapping = group_median(rows, label, value).select(label, (F.row_number().over(order) - 1).alias(name))
    return rows.join(F.broadcast(mapping), label)


def weighted_std(value: Column, weight: Column) -> Column:
    """Population standard deviation over positive finite weights and finite values."""
    fine = (weight > 0) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (weight < float("inf"))
    w, x = F.when(fine, weight), F.when(fine, value)
    mean = F.try_divide(F.sum(w * x), F.sum(w))
    return F.sqrt(F.greatest(F.try_divide(F.sum(w * x * x), F.sum(w)) - mean * mean, F.lit(0.0)))


def conf_bin_stats(rows: DataFrame, value: str, confidence: str) -> DataFrame:
    """Count, median and mean of the absolute value per confidence interval."""
    binned = rows.select(conf_bins(F.col(confidence)).alias("confidence_bin"), F.abs(value).alias("_size"))
    sums = binned.groupBy("confidence_bin").agg(F.count("_size").alias("count"), F.avg("_size").alias("mean"))
    middle = group_median(binned, "confidence_bin", "_size")
    return sums.join(F.broadcast(middle), "confidence_bin", "left").select("confidence_bin", "count", "median", "mean")  # four bins


def extreme_fractions(rows: DataFrame, value: str, confidence: str, q: float = 0.95) -> DataFrame:
    """Shares of rows at or beyond the quantile of the absolute value: all, of low and of high confidence."""
    limit = global_quantile(rows.select(F.abs(value).alias("_size")), "_size", q, "threshold")
    hit = (F.abs(value) >= F.col("threshold")).cast("int")
    return rows.join(F.broadcast(limit)).groupBy("threshold").agg(F.avg(hit).alias("fraction_all"), F.avg(F.when(F.col(confidence) < 0.4, hit)).alias("fraction_low"), F.avg(F.when(F.col(confidence) >= 0.7, hit)).alias("fraction_high"))


def group_summary(rows: DataFrame, groups: Sequence[str], value: str, side: str, a: str = "A", b: str = "B") -> DataFrame:
    """n, mean and median of each side, and Cohen's d."""
    in_a, in_b = F.col(side) == a, F.col(side) == b
    x = F.col(value)
    sums = rows.groupBy(*groups).agg(
        F.count(F.when(in_a, x)).alias("n_a"),
        F.count(F.when(in_b, x)).alias("n_b"),
        F.avg(F.when(in_a, x)).alias("mean_a"),
        F.avg(F.when(in_b, x)).alias("mean_b"),
        cohens_d(x, in_a, in_b).alias("cohens_d"),
    )
    sides = rows.filter(in_a | in_b).select(*groups, F.col(side).alias("_side"), x.alias("_x"))
    medians = order_statistics(sides, "_x", [0.5], [*groups, "_side"]).groupBy(*groups).agg(*(F.max(F.when(F.col("_side") == v, F.col("q0"))).alias(f"median_{n}") for n, v in (("a", a), ("b", b))))
    return join_null_safe(sums, medians, groups, "left").select(*groups, "n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", "cohens_d")
