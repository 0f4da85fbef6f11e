"""Quality filter, lattice binning, cell aggregates and counts per cell and gene (long and sparse)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quality limit, control prefixes, lattice size, smallest cell.
QV_THRESHOLD = 10.0
CONTROL_PREFIXES = ("NegControl", "Unassigned", "BLANK")
BIN_SIZE_UM = 10.0
MIN_COUNT = 10
CELL = ("x_bin", "y_bin")


def qc_condition(threshold: float = QV_THRESHOLD, prefixes: Sequence[str] = CONTROL_PREFIXES) -> Column:
    keep = F.col("qv") >= threshold
    for prefix in prefixes:
        keep = keep & ~F.startswith("feature_name", F.lit(prefix))
    return keep


def qc_filter(points: DataFrame, threshold: float = QV_THRESHOLD, prefixes: Sequence[str] = CONTROL_PREFIXES) -> DataFrame:
    """Detections of enough quality that are no controls; nulls go."""
    return points.filter(qc_condition(threshold, prefixes))


def bin_points(points: DataFrame, size: float = BIN_SIZE_UM) -> DataFrame:
    return points.withColumns({f"{a}_bin": F.floor(F.col(f"{a}_location") / size).cast("int") for a in "xy"})


def cell_centre(cells: DataFrame, size: float = BIN_SIZE_UM) -> DataFrame:
    return cells.withColumns({f"{a}_um": F.col(f"{a}_bin") * size + size / 2 for a in "xy"})


def cell_agg(binned: DataFrame) -> DataFrame:
    """Detections and mean z of each cell."""
    return binned.groupBy(*CELL).agg(F.count("*").alias("transcript_count"), F.avg("z_location").alias("z_mean_um"))


def min_count_filter(cells: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    return cells.filter(F.col("transcript_count") >= least)


def lattice_cells(points: DataFrame, least: int = MIN_COUNT, size: float = BIN_SIZE_UM) -> DataFrame:
    """From detections to cells with centres: filter, bin, aggregate, drop sparse cells."""
    return cell_centre(min_count_filter(cell_agg(bin_points(qc_filter(points), size)), least), size)


def finite_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all numbers: no null, NaN or infinity."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.filter(fine)


def region_label(label: Column) -> Column:
    return F.when(label >= 0, F.concat(F.lit("Cluster "), label.cast("string"))).otherwise("Unassigned")


def compare_group(label: Column, a: int, b: int, name_a: str = "A", name_b: str = "B") -> Column:
    return F.when(label == a, name_a).when(label == b, name_b).otherwise("")


def cell_gene_counts(binned: DataFrame) -> DataFrame:
    """Detections per cell and gene. Partial counts are made map-side; labels are joined afterwards."""
    return binned.groupBy(*CELL, "feature_name").agg(F.count("*").alias("count"))


def points_cells_join(counts: DataFrame, cells: DataFrame, columns: Sequence[str] = ("cluster_sorted",)) -> DataFrame:
    """Counts of labelled cells."""
    return counts.join(cells.select(*CELL, *columns), list(CELL))


def gene_subset(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of listed genes; ``genes`` has a feature_name column."""
    return counts.join(genes.select("feature_name").distinct(), "feature_name", "left_semi")


def count_pivot(counts: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Cells by genes, zero-filled; for presentation only."""
    return counts.groupBy(*CELL).pivot("feature_name", list(genes)).agg(F.sum("count")).na.fill(0)


def cpm(counts: DataFrame) -> DataFrame:
    """Adds lib_size and cpm, counts per million of the cell's counted detections."""
    sized = counts.withColumn("lib_size", F.sum("count").over(Window.partitionBy(*CELL)))
    return sized.withColumn("cpm", F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("lib_size").cast("double")), F.lit(0.0)) * 1e6)


def cpm_by_total(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """CPM with the cell's total detections as its size."""
    joined = counts.join(cells.select(*CELL, "transcript_count"), list(CELL))
    return joined.withColumn("cpm", F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("transcript_count").cast("double")), F.lit(0.0)) * 1e6)


def panel_cpm(counts: DataFrame, panel: DataFrame, least: int = 5) -> DataFrame:
    """CPM within a gene panel; cells with fewer panel detections go."""
    return cpm(gene_subset(counts, panel)).filter(F.col("lib_size") >= least)


def distinct_values(cells: DataFrame, label: str = "cluster_sorted") -> DataFrame:
    """Cells of each label."""
    return cells.groupBy(label).agg(F.count("*").alias("n_cells"))
