"""Queries over sources, projections, filters, cell aggregates and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.operators import grid
from binfields.operators.grid import CELL
from binfields.plans import fixture as fx
from binfields.plans.fixture import A, B, query, rounded
from binfields.sources import tables
from binfields.sources.scratch import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select round(x_location, 6) as x_location, round(y_location, 6) as y_location, round(z_location, 6) as z_location, feature_name, qv from points")
def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "points")
    fx.points(spark, sf_dir).withColumn("unused", F.lit(1)).write.parquet(path)
    return rounded(tables.read_points(spark, path))


@query("select count(*) as raw_count, (select count(*) from qc) as retained_count, cast(42638083 as bigint) as expected_count from points")
def raw_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_count(fx.points(spark, sf_dir), grid.qc_condition())


@query('select gene, grp as "group" from marker_groups')
def read_marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "groups")
    rows = fx.marker_groups(spark, sf_dir)
    rows.unionByName(rows.select("gene", F.lit(None).cast("string").alias("group"))).write.csv(path, header=True)
    return tables.read_marker_groups(spark, path)


@query("select library, term, gene from gene_sets where library = 'types'")
def read_gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "sets")
    rows = fx.gene_sets(spark, sf_dir).filter("library = 'types'")
    lines = rows.groupBy("term").agg(F.concat_ws("\t", F.first("term"), F.lit("note"), F.array_join(F.collect_list("gene"), "\t")).alias("value"))
    lines.select("value").write.text(path)
    return tables.read_gene_sets(spark, path, "types")


@query("select x_bin, y_bin, transcript_count, round(z_mean_um, 6) as z_mean_um, x_um, y_um, cast(floor(x_bin / 64e0) as integer) as tile_x from cells")
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "cells")
    tables.write_results(fx.cells(spark, sf_dir), path)
    return rounded(spark.read.parquet(path))


@query("select round(x_location, 6) as x_location, round(y_location, 6) as y_location, round(z_location, 6) as z_location, qv, feature_name from qc")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.qc_filter(fx.points(spark, sf_dir)))


@query("select x_bin, y_bin, feature_name, round(x_location - 10 * x_bin, 6) as dx from binned")
def bin_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.binned(spark, sf_dir).select(*CELL, "feature_name", (F.col("x_location") - 10 * F.col("x_bin")).alias("dx")))


@query("select x_bin, y_bin, transcript_count, round(z_mean_um, 6) as z_mean_um from all_cells")
def cell_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.cell_agg(fx.binned(spark, sf_dir)))


@query("select x_bin, y_bin, x_bin * 10e0 + 5e0 as x_um, y_bin * 10e0 + 5e0 as y_um from all_cells")
def cell_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_centre(grid.cell_agg(fx.binned(spark, sf_dir))).select(*CELL, "x_um", "y_um")


@query("select x_bin, y_bin, transcript_count from cells")
def min_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select(*CELL, "transcript_count")


@query("select feature_name, qv, v from (select *, case when qv < 15 then cast('nan' as double) when qv > 45 then cast('inf' as double) when qv = 20 then null else qv end as v from qc) where v is not null and isfinite(v)")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("qv") < 15, F.lit(float("nan"))).when(F.col("qv") > 45, F.lit(float("inf"))).when(F.col("qv") != 20, F.col("qv"))
    rows = grid.qc_filter(fx.points(spark, sf_dir)).withColumn("v", v)
    return grid.finite_rows(rows, ["v"]).select("feature_name", "qv", "v")


@query("select x_bin, y_bin, case when l >= 0 then 'Cluster ' || l else 'Unassigned' end as region from (select *, cluster_sorted - 1 as l from labelled)")
def region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.labelled(spark, sf_dir).select(*CELL, grid.region_label(F.col("cluster_sorted") - 1).alias("region"))


@query("select x_bin, y_bin, region from labelled")
def compare_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.labelled(spark, sf_dir).select(*CELL, grid.compare_group(F.col("cluster_sorted"), A, B).alias("region"))


@query("select x_bin, y_bin, feature_name, count from counts where feature_name in (select gene from marker_groups where grp = 'CORE')")
def gene_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = fx.marker_groups(spark, sf_dir).filter("`group` = 'CORE'").select(F.col("gene").alias("feature_name"))
    return grid.gene_subset(fx.counts(spark, sf_dir), genes).select(*CELL, "feature_name", "count")


@query("select x_bin, y_bin, feature_name, cluster_sorted, count from counts")
def points_cells_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = grid.cell_gene_counts(fx.binned(spark, sf_dir))
    return grid.points_cells_join(plain, fx.labelled(spark, sf_dir)).select(*CELL, "feature_name", "cluster_sorted", "count")


@query("select x_bin, y_bin, feature_name, cluster_sorted, count from counts where cluster_sorted in (1, 2) and starts_with(feature_name, 'RIM_')")
def scale_points_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = fx.marker_groups(spark, sf_dir).filter("`group` = 'RIM'").select(F.col("gene").alias("feature_name"))
    some = grid.gene_subset(grid.cell_gene_counts(fx.binned(spark, sf_dir)), genes)
    compared = fx.labelled(spark, sf_dir).filter(F.col("cluster_sorted").isin(A, B))
    return grid.points_cells_join(some, compared).select(*CELL, "feature_name", "cluster_sorted", "count")


@query("select x_bin, y_bin, feature_name, count from plain_counts")
def cell_gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_gene_counts(fx.binned(spark, sf_dir))


@query("""select x_bin, y_bin, cast(sum(case when feature_name = 'Brand11' then count else 0 end) as bigint) as "Brand11",
 cast(sum(case when feature_name = 'Brand22' then count else 0 end) as bigint) as "Brand22", cast(sum(case when feature_name = 'Brand33' then count else 0 end) as bigint) as "Brand33"
 from counts group by x_bin, y_bin""")
def count_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.count_pivot(fx.counts(spark, sf_dir).select(*CELL, "feature_name", "count"), ["Brand11", "Brand22", "Brand33"])


@query("select x_bin, y_bin, feature_name, count, lib_size, round(cpm, 6) as cpm from counts")
def cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.counts(spark, sf_dir).drop("cluster_sorted"))


@query("select x_bin, y_bin, feature_name, round(cast(count as double) / transcript_count * 1e6, 6) as cpm from counts join cells using (x_bin, y_bin)")
def cpm_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = fx.counts(spark, sf_dir).drop("lib_size", "cpm")
    return rounded(grid.cpm_by_total(plain, fx.cells(spark, sf_dir)).select(*CELL, "feature_name", "cpm"))


@query("""select x_bin, y_bin, feature_name, lib_size, round(cast(count as double) / lib_size * 1e6, 6) as cpm
 from (select x_bin, y_bin, feature_name, count, cast(sum(count) over (partition by x_bin, y_bin) as bigint) as lib_size from counts
       where feature_name in (select gene from marker_groups where grp <> 'Brand')) where lib_size >= 5""")
def panel_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = fx.marker_groups(spark, sf_dir).filter("`group` <> 'Brand'").select(F.col("gene").alias("feature_name"))
    return rounded(grid.panel_cpm(fx.counts(spark, sf_dir).drop("lib_size", "cpm"), panel).select(*CELL, "feature_name", "lib_size", "cpm"))


@query("select cluster_sorted, count(*) as n_cells from labelled group by cluster_sorted")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.distinct_values(fx.labelled(spark, sf_dir))
