"""Differential abundance per gene: one against the rest, A against B, over scales, within a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binfields.functions.ranks import bh_fdr, rank_sums, rank_test
from binfields.functions.scalar import clip_range, dge_category, minus_log10
from binfields.operators.grid import CELL
from binfields.operators.potts import top_per_group

PSEUDOCOUNT = 1.0


def log2_fold_change(mean_a: Column, mean_b: Column) -> Column:
    return F.log2((mean_a + PSEUDOCOUNT) / (mean_b + PSEUDOCOUNT))


def group_sizes(cells: DataFrame, label: str) -> DataFrame:
    return cells.groupBy(label).agg(F.count("*").alias("n_cells"))


def gene_means(counts: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """gene, label, n_cells, mean_cpm, mean_log1p, pct over all cells of the label; cells without the gene count as zero."""
    sizes = group_sizes(cells, label)
    grid = counts.select("feature_name").distinct().join(F.broadcast(sizes))
    sums = counts.groupBy("feature_name", label).agg(F.sum("cpm").alias("_cpm"), F.sum(F.log1p("cpm")).alias("_log"), F.count_if(F.col("count") > 0).alias("_n"))
    n = F.col("n_cells")
    zero = [F.coalesce(c, F.lit(0)) / n for c in ("_cpm", "_log", "_n")]
    return grid.join(sums, ["feature_name", label], "left").select("feature_name", label, "n_cells", zero[0].alias("mean_cpm"), zero[1].alias("mean_log1p"), zero[2].alias("pct"))


def marker_ranking(counts: DataFrame, cells: DataFrame, label: str = "cluster_sorted", least_cells: int = 3) -> DataFrame:
    """Each cluster against the rest: score, log2fc, pct, means of log1p inside and outside, u, z, pval, fdr (per cluster).

    ``counts`` has feature_name, label, count and cpm; one rank pass serves all clusters.
    """
    means = gene_means(counts, cells, label)
    n = F.col("n_cells")
    totals = means.groupBy("feature_name").agg(F.sum(F.col("mean_cpm") * n).alias("_c"), F.sum(F.col("mean_log1p") * n).alias("_l"), F.sum(n).alias("_n"))
    rest = F.col("_n") - n
    out_cpm, out_log = F.try_divide(F.col("_c") - F.col("mean_cpm") * n, rest), F.try_divide(F.col("_l") - F.col("mean_log1p") * n, rest)
    compared = means.join(totals, "feature_name").select(
        "feature_name", label, log2_fold_change(F.col("mean_cpm"), out_cpm).alias("log2fc"), "pct", F.col("mean_log1p").alias("mean_log1p_in"), out_log.alias("mean_log1p_out")
    )
    sums = rank_sums(counts, group_sizes(cells, label), label).filter((F.col("n1") >= least_cells) & (F.col("n2") >= least_cells))
    return bh_fdr(rank_test(sums).join(compared, ["feature_name", label]), "pval", [label], "fdr")


def topn_per_cluster(ranking: DataFrame, n: int = 20, label: str = "cluster_sorted") -> DataFrame:
    return top_per_group(ranking, [label], [F.desc("score"), F.col("feature_name")], n)


def marker_text(lfc_min: float = 1.0, pct_min: float = 0.2, fdr_max: float = 0.05) -> Column:
    def flag(condition: Column, text: str) -> Column:
        return F.when(condition, text).otherwise("")

    return F.concat("feature_name", flag(F.col("log2fc") > lfc_min, f" [LFC>{lfc_min}]"), flag(F.col("pct") > pct_min, f" [PCT>{pct_min}]"), flag(F.col("fdr") < fdr_max, f" [FDR<{fdr_max}]"))


def pairwise_dge(counts: DataFrame, cells: DataFrame, a: int, b: int, label: str = "cluster_sorted") -> DataFrame:
    """A against B per gene: means, log2FC, Mean_CPM, u, z, pval, qval and flags."""
    two = F.col(label).isin(a, b)
    some, inside = counts.filter(two), cells.filter(two)
    means = gene_means(some, inside, label).groupBy("feature_name").agg(*(F.max(F.when(F.col(label) == k, F.col("mean_cpm"))).alias(n) for k, n in ((a, "cpm_a"), (b, "cpm_b"))))
    means = means.withColumn("log2FC", log2_fold_change(F.col("cpm_a"), F.col("cpm_b"))).withColumn("Mean_CPM", (F.col("cpm_a") + F.col("cpm_b")) / 2)
    tested = rank_test(rank_sums(some, group_sizes(inside, label), label)).filter(F.col(label) == a).drop(label)
    return dge_flags(bh_fdr(tested.join(means, "feature_name"), "pval"))


def dge_flags(rows: DataFrame, *, q_max: float = 0.05, lfc_min: float = 0.25, mean_min: float = 5.0) -> DataFrame:
    significant = F.col("qval") < q_max
    practical = significant & (F.abs("log2FC") >= lfc_min) & (F.col("Mean_CPM") >= mean_min)
    return rows.withColumn("nlog10_qval", minus_log10(F.col("qval"))).withColumn("is_stat_sig", significant).withColumn("is_practical_sig", practical)


def categorized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category", dge_category(F.col("qval"), F.col("log2FC"), F.col("Mean_CPM")))


def dge_top_both(rows: DataFrame, n: int = 20, columns: Sequence[str] = ("log2FC", "Mean_CPM", "cpm_a", "cpm_b")) -> DataFrame:
    """The n most raised and n most lowered genes, once each, with direction and rounded numbers."""
    up = rows.orderBy(F.desc("log2FC"), "feature_name").limit(n)
    down = rows.orderBy("log2FC", "feature_name").limit(n)
    both = up.unionByName(down).dropDuplicates(["feature_name"])
    return both.select("feature_name", F.when(F.col("log2FC") > 0, "A").otherwise("B").alias("direction"), *(F.round(c, 2).alias(c) for c in columns))


def sig_gene_rank(rows: DataFrame, n: int = 60, q_max: float = 0.05, mean_min: float = 5.0) -> DataFrame:
    fine = rows.filter((F.col("qval") < q_max) & (F.col("Mean_CPM") >= mean_min))
    return fine.orderBy("qval", F.desc(F.abs("log2FC")), "feature_name").limit(n)


def gene_list_union(significant: DataFrame, manual: DataFrame, present: DataFrame) -> DataFrame:
    """Genes of the first list, then those of the second, first place kept, only those in the data: feature_name, place."""
    both = significant.select("feature_name", F.col("place").cast("long").alias("place")).unionByName(manual.select("feature_name", (F.col("place") + 1_000_000).cast("long").alias("place")))
    return both.groupBy("feature_name").agg(F.min("place").alias("place")).join(present.select("feature_name").distinct(), "feature_name", "left_semi")


def panel_dge(counts: DataFrame, cells: DataFrame, a: int, b: int, label: str = "cluster_sorted", least_mean: float = 10.0) -> DataFrame:
    """DGE on panel CPM (``counts`` from panel_cpm with the label): genes with enough mean CPM in either group; FDR over those."""
    sized = counts.select(*CELL, label).distinct()
    tested = pairwise_dge(counts, sized, a, b, label)
    return bh_fdr(tested.filter((F.col("cpm_a") >= least_mean) | (F.col("cpm_b") >= least_mean)).drop("qval"), "pval")


def panel_report(rows: DataFrame, n: int = 15, q_max: float = 0.05, lfc_min: float = 0.5) -> DataFrame:
    """Significant genes beyond the fold limit, the first n of each side by falling log2FC."""
    sided = rows.filter((F.col("qval") < q_max) & (F.abs("log2FC") > lfc_min)).withColumn("side", F.when(F.col("log2FC") > 0, "A").otherwise("B"))
    return top_per_group(sided, ["side"], [F.desc("log2FC"), F.col("feature_name")], n)


def multiscale_dge(counts: DataFrame, scales: DataFrame, a: int, b: int, *, genes: DataFrame | None = None, least_cells: int = 100, least_group: int = 25) -> DataFrame:
    """A against B for every scale at once; FDR over all scales and genes together.

    ``scales`` has sigma_um, x_bin, y_bin, transcript_count and cluster_sorted. CPM has the cell's total as its size. Cells
    without any of the genes have no rows and so are in no group.
    """
    some = counts if genes is None else counts.join(genes.select("feature_name").distinct(), "feature_name", "left_semi")
    rated = some.join(scales, list(CELL)).withColumn("cpm", F.try_divide(F.col("count").cast("double"), F.col("transcript_count").cast("double")) * 1e6)
    rated = rated.filter(F.col("cluster_sorted").isin(a, b)).withColumn("item", F.struct("sigma_um", "feature_name"))
    present = rated.select("sigma_um", *CELL, "cluster_sorted").distinct()
    sizes = present.groupBy("sigma_um").agg(F.count("*").alias("n"), *(F.count_if(F.col("cluster_sorted") == k).alias(f"n_{s}") for k, s in ((a, "a"), (b, "b"))))
    kept = sizes.filter((F.col("n") >= least_cells) & (F.col("n_a") >= least_group) & (F.col("n_b") >= least_group))
    out = None
    for row in kept.collect():  # one row for each scale
        own = rated.filter(F.col("sigma_um") == row["sigma_um"]).drop("item")
        cells = present.filter(F.col("sigma_um") == row["sigma_um"])
        tested = pairwise_dge(own, cells, a, b).withColumn("sigma_um", F.lit(row["sigma_um"]))
        out = tested if out is None else out.unionByName(tested)
    if out is None:
        raise ValueError("no scale has enough cells in both groups")
    joint = bh_fdr(out.drop("qval"), "pval").withColumn("significance_score", minus_log10(F.col("qval")))
    return joint.withColumn("vis_size", clip_range(F.col("significance_score"), None, 50.0))
