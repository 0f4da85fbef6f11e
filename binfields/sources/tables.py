"""Sources and sinks: detections, marker groups, gene sets, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_COLUMNS = ("x_location", "y_location", "z_location", "feature_name", "qv")
# Fixed value: the number of detections expected.
EXPECTED_RAW_COUNT = 42_638_083
TILE_BINS = 64


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Detections from Parquet, only the columns in use, with the name as a string."""
    return spark.read.parquet(path).select(*POINT_COLUMNS[:3], F.col("feature_name").cast("string").alias("feature_name"), F.col("qv").cast("double").alias("qv"))


def raw_count(points: DataFrame, keep: Column, expected: int = EXPECTED_RAW_COUNT) -> DataFrame:
    """Raw, retained and expected numbers of rows in one pass."""
    return points.agg(F.count("*").alias("raw_count"), F.count_if(keep).alias("retained_count"), F.lit(expected).cast("long").alias("expected_count"))


def read_marker_groups(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (gene, group) of a CSV with header; rows with either null go."""
    return spark.read.schema("gene string, `group` string").csv(path, header=True).na.drop(subset=["gene", "group"]).distinct()


def read_gene_sets(spark: SparkSession, path: str, library: str) -> DataFrame:
    """(library, term, gene) of a GMT text: term, a note and genes, separated by tabs."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(F.lit(library).alias("library"), fields[0].alias("term"), F.explode(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0)))).alias("gene")).filter("gene <> ''").distinct()


def tile_of(name: str, tile_bins: int = TILE_BINS) -> Column:
    return F.floor(F.col(name) / tile_bins).cast("int")


def write_results(cells: DataFrame, path: str, tile_bins: int = TILE_BINS) -> None:
    """Cell tables are partitioned by tile column, so that a region's cells are read alone."""
    cells.withColumn("tile_x", tile_of("x_bin", tile_bins)).write.mode("overwrite").partitionBy("tile_x").parquet(path)
