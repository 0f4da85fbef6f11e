"""Scores of marker groups per cell, and their comparison between regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfields.functions.ranks import bh_fdr, midrank, rank_test
from binfields.functions.scalar import minus_log10
from binfields.functions.summary import group_summary
from binfields.operators.grid import CELL


def marker_members(groups: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Genes of each group that occur in the data; groups with enough of them: marker_group, feature_name, n_genes."""
    pairs = groups.select(F.col("group").alias("marker_group"), F.col("gene").alias("feature_name")).distinct()
    present = pairs.join(counts.select("feature_name").distinct(), "feature_name", "left_semi")
    sizes = present.groupBy("marker_group").agg(F.count("*").alias("n_genes")).filter(F.col("n_genes") >= least)
    return present.join(F.broadcast(sizes), "marker_group")


def marker_scores(counts: DataFrame, cells: DataFrame, members: DataFrame) -> DataFrame:
    """x_bin, y_bin, marker_group, score = log1p of the mean CPM over the group's genes; zeros count."""
    sums = counts.join(F.broadcast(members), "feature_name").groupBy(*CELL, "marker_group").agg(F.sum("cpm").alias("_s"))
    sizes = members.select("marker_group", "n_genes").distinct()
    grid = cells.select(*CELL).join(F.broadcast(sizes))  # groups are few
    return grid.join(sums, [*CELL, "marker_group"], "left").select(*CELL, "marker_group", F.log1p(F.coalesce("_s", F.lit(0.0)) / F.col("n_genes")).alias("score"))


def score_coord_join(scores: DataFrame, cells: DataFrame, columns: Sequence[str] = ("x_um", "y_um")) -> DataFrame:
    return scores.join(cells.select(*CELL, *columns).dropDuplicates(list(CELL)), list(CELL), "left")


def score_field_join(scores: DataFrame, fields: DataFrame, columns: Sequence[str]) -> DataFrame:
    return scores.join(fields.select(*CELL, *columns), list(CELL))


def dominant_group(scores: DataFrame) -> DataFrame:
    """Group with the highest score of each cell; of equal ones the first by name."""
    best = scores.groupBy(*CELL).agg(F.max("score").alias("_best"))
    return scores.join(best, list(CELL)).filter("score = _best").groupBy(*CELL).agg(F.min("marker_group").alias("dominant_group"))


def two_sided(rows: DataFrame, groups: Sequence[str], value: str, side: str, a: str = "A", b: str = "B") -> DataFrame:
    """groups, n1, n2, u of side a against side b by midranks, ties."""
    some = rows.filter(F.col(side).isin(a, b) & F.col(value).isNotNull())
    ranked = midrank(some, value, groups, "_rank")
    n1 = F.count_if(F.col(side) == a)
    sums = ranked.groupBy(*groups).agg(n1.alias("n1"), F.count_if(F.col(side) == b).alias("n2"), F.sum(F.when(F.col(side) == a, F.col("_rank"))).alias("_r"))
    t = F.col("t").cast("double")
    ties = some.groupBy(*groups, value).agg(F.count("*").alias("t")).groupBy(*groups).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1").cast("double")
    return sums.join(ties, list(groups)).select(*groups, "n1", "n2", (F.coalesce("_r", F.lit(0.0)) - n * (n + 1) / 2).alias("u"), "ties")


def marker_group_test(scores: DataFrame, region: str = "region") -> DataFrame:
    """Per group A against B: sizes, means, medians, Cohen's d, u, z, p and q over all groups."""
    summary = group_summary(scores, ["marker_group"], "score", region)
    tested = rank_test(two_sided(scores, ["marker_group"], "score", region)).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    joined = summary.join(tested.select("marker_group", "u", "z", F.col("pval").alias("pval_mwu")), "marker_group")
    return bh_fdr(joined, "pval_mwu", name="qval_mwu").withColumn("neglog10_qval_mwu", minus_log10(F.col("qval_mwu")))


def effect_rank(table: DataFrame, n: int = 12) -> DataFrame:
    return table.withColumn("abs_d", F.abs("cohens_d")).orderBy(F.desc_nulls_last("abs_d"), "marker_group").limit(n)
