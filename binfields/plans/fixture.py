"""Detections derived from the given tables, and the tables that later stages start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.operators import grid
from binfields.operators.grid import CELL

A, B = 1, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL after the common tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = BASE_SQL + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in order."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def normal_sql(z: str, steps: int = 400) -> str:
    """The normal distribution function in SQL, by Simpson's rule from 0 to z; beyond 12 nothing is left."""
    end = f"least(greatest({z}, -12e0), 12e0)"
    terms = f"list_transform(range(0, {steps + 1}), lambda i: (case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-5e-1 * power({end} * i / {steps}e0, 2)))"
    return f"(5e-1 + {end} / {steps * 3}e0 * list_sum({terms}) / sqrt(2 * pi()))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from line items: x from the price (squared, so density is uneven), y from the date, names from the part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    u = (F.col("l_extendedprice") - 900.0) / 104100.0
    joined = items.join(parts, items["l_partkey"] == parts["p_partkey"]).withColumn("u", u)
    name = (
        F.when(F.startswith("p_name", F.lit("old ")), F.concat(F.lit("NegControlProbe_"), "p_brand"))
        .when(F.startswith("p_name", F.lit("hot ")), F.concat(F.lit("BLANK_"), "p_brand"))
        .when((F.col("u") < 0.45) & (F.col("l_linenumber") <= 2), F.concat(F.lit("CORE_"), "p_type"))
        .when((F.col("u") >= 0.45) & (F.col("l_linenumber") >= 6), F.concat(F.lit("RIM_"), "p_type"))
        .otherwise(F.replace("p_brand", F.lit("#"), F.lit("")))
    )
    return joined.select(
        (400.0 * F.col("u") * F.col("u")).alias("x_location"),
        (0.16 * F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-02").cast("date"))).alias("y_location"),
        (5.0 + 100.0 * F.col("l_discount") + 6.0 * F.col("u")).alias("z_location"),
        F.col("l_quantity").cast("double").alias("qv"),
        name.alias("feature_name"),
    )


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bin_points(grid.qc_filter(points(spark, sf_dir)))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.lattice_cells(points(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with given labels, so that what follows does not depend on clustering."""
    label = F.when(F.col("x_bin") < 8, 0).when(F.col("x_bin") < 18, 1).otherwise(2)
    return cells(spark, sf_dir).withColumn("cluster_sorted", label).withColumn("region", grid.compare_group(F.col("cluster_sorted"), A, B))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of labelled cells per gene, with CPM."""
    return grid.cpm(grid.points_cells_join(grid.cell_gene_counts(binned(spark, sf_dir)), labelled(spark, sf_dir)))


def marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    gene = F.col("feature_name")
    group = F.when(F.startswith(gene, F.lit("CORE_")), "CORE").when(F.startswith(gene, F.lit("RIM_")), "RIM").otherwise("Brand")
    return grid.qc_filter(points(spark, sf_dir)).select(gene.alias("gene"), group.alias("group")).distinct()


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two libraries: genes by part type, and by family."""
    groups = marker_groups(spark, sf_dir)
    types = groups.filter(F.col("group") != "Brand").select(F.lit("types").alias("library"), F.regexp_replace("gene", "^(CORE|RIM)_", "").alias("term"), "gene")
    return types.unionByName(groups.select(F.lit("family").alias("library"), F.col("group").alias("term"), "gene"))


BASE_SQL = """
with points as (
    select 400e0 * u * u as x_location, 16e-2 * date_diff('day', date '1995-01-02', cast(l_shipdate as date)) as y_location,
           5e0 + 100e0 * l_discount + 6e0 * u as z_location, cast(l_quantity as double) as qv,
           case when starts_with(p_name, 'old ') then 'NegControlProbe_' || p_brand
                when starts_with(p_name, 'hot ') then 'BLANK_' || p_brand
                when u < 45e-2 and l_linenumber <= 2 then 'CORE_' || p_type
                when u >= 45e-2 and l_linenumber >= 6 then 'RIM_' || p_type
                else replace(p_brand, '#', '') end as feature_name
    from (select *, (l_extendedprice - 900e0) / 104100e0 as u from lineitem join part on l_partkey = p_partkey)),
qc as (
    select * from points
    where qv >= 10 and not starts_with(feature_name, 'NegControl') and not starts_with(feature_name, 'Unassigned') and not starts_with(feature_name, 'BLANK')),
binned as (select *, cast(floor(x_location / 10e0) as integer) as x_bin, cast(floor(y_location / 10e0) as integer) as y_bin from qc),
all_cells as (select x_bin, y_bin, count(*) as transcript_count, avg(z_location) as z_mean_um from binned group by x_bin, y_bin),
cells as (select *, x_bin * 10e0 + 5e0 as x_um, y_bin * 10e0 + 5e0 as y_um from all_cells where transcript_count >= 10),
labelled as (
    select *, case cluster_sorted when 1 then 'A' when 2 then 'B' else '' end as region
    from (select *, case when x_bin < 8 then 0 when x_bin < 18 then 1 else 2 end as cluster_sorted from cells)),
plain_counts as (select x_bin, y_bin, feature_name, count(*) as count from binned group by all),
counts as (
    select *, cast(count as double) / cast(lib_size as double) * 1e6 as cpm
    from (select p.*, cluster_sorted, cast(sum(count) over (partition by x_bin, y_bin) as bigint) as lib_size
          from plain_counts p join (select x_bin, y_bin, cluster_sorted from labelled) using (x_bin, y_bin))),
marker_groups as (
    select distinct feature_name as gene, case when starts_with(feature_name, 'CORE_') then 'CORE' when starts_with(feature_name, 'RIM_') then 'RIM' else 'Brand' end as grp
    from qc),
gene_sets as (
    select 'types' as library, regexp_replace(gene, '^(CORE|RIM)_', '') as term, gene from marker_groups where grp <> 'Brand'
    union all select 'family', grp, gene from marker_groups),
dense as (
    select g.feature_name, c.x_bin, c.y_bin, c.cluster_sorted, coalesce(l.cpm, 0) as cpm, coalesce(l.count, 0) as count
    from (select distinct feature_name from counts) g cross join labelled c left join counts l on l.feature_name = g.feature_name and l.x_bin = c.x_bin and l.y_bin = c.y_bin),
pair_dense as (
    select * from dense where cluster_sorted in (1, 2) and feature_name in (select feature_name from counts where cluster_sorted in (1, 2))),
pair_ranked as (
    select *, rank() over (partition by feature_name order by cpm) + (t - 1) / 2e0 as mid
    from (select *, count(*) over (partition by feature_name, cpm) as t from pair_dense)),
pair_u as (
    select feature_name, count(*) filter (cluster_sorted = 1) as n1, count(*) filter (cluster_sorted = 2) as n2,
           sum(mid) filter (cluster_sorted = 1) as r, sum(cast(t as double) * t - 1) as ties,
           avg(cpm) filter (cluster_sorted = 1) as cpm_a, avg(cpm) filter (cluster_sorted = 2) as cpm_b
    from pair_ranked group by feature_name),
pair_z as (
    select *, case when v > 0 then (greatest(u, n1 * n2 - u) - n1 * n2 / 2e0 - 0.5e0) / sqrt(v) else 0 end as z,
           log2((cpm_a + 1) / (cpm_b + 1)) as log2FC, (cpm_a + cpm_b) / 2 as Mean_CPM
    from (select *, r - n1 * (n1 + 1) / 2e0 as u, n1 * n2 / 12e0 * ((n1 + n2 + 1) - ties / (cast(n1 + n2 as double) * (n1 + n2 - 1))) as v from pair_u)),
pair_p as (select *, exp(-10 * z) as pval, row_number() over (order by exp(-10 * z)) as pr, count(*) over () as pm from pair_z),
dge as (
    select *, qval < 5e-2 as is_stat_sig, qval < 5e-2 and abs(log2FC) >= 25e-2 and Mean_CPM >= 5 as is_practical_sig
    from (select *, least(min(pval * pm / pr) over (order by pr desc rows between unbounded preceding and current row), 1) as qval from pair_p)),
two as (select * from labelled where region in ('A', 'B')),
boundary as (
    select distinct a.x_bin, a.y_bin from two a join two b on a.region <> b.region and abs(a.x_bin - b.x_bin) <= 3 and abs(a.y_bin - b.y_bin) <= 3
     and (a.x_bin - b.x_bin) * (a.x_bin - b.x_bin) + (a.y_bin - b.y_bin) * (a.y_bin - b.y_bin) <= 9),
nearest as (
    select t.x_bin, t.y_bin, min((t.x_bin - b.x_bin) * (t.x_bin - b.x_bin) + (t.y_bin - b.y_bin) * (t.y_bin - b.y_bin)) as d2
    from two t cross join boundary b group by t.x_bin, t.y_bin),
signed as (
    select t.*, (b.x_bin is not null) as is_boundary, case when d2 = 0 then 0e0 when region = 'B' then -10 * sqrt(cast(d2 as double)) else 10 * sqrt(cast(d2 as double)) end as signed_dist_um
    from two t join nearest using (x_bin, y_bin) left join boundary b on b.x_bin = t.x_bin and b.y_bin = t.y_bin),
members as (
    select grp as marker_group, gene as feature_name, count(*) over (partition by grp) as n_genes
    from marker_groups where gene in (select feature_name from counts) qualify count(*) over (partition by grp) >= 2),
scores as (
    select c.x_bin, c.y_bin, c.region, g.marker_group, ln(1 + coalesce(s, 0) / g.n_genes) as score
    from labelled c cross join (select distinct marker_group, n_genes from members) g
    left join (select x_bin, y_bin, marker_group, sum(cpm) as s from counts join members using (feature_name) group by all) t
      on t.x_bin = c.x_bin and t.y_bin = c.y_bin and t.marker_group = g.marker_group),
long_signed as (
    select x_bin, y_bin, signed_dist_um, unnest(['z', 'n']) as feature, unnest([z_mean_um, cast(transcript_count as double)]) as value from signed),
profile as (
    select feature, -400 + 40 * (greatest(ceil((signed_dist_um + 400) / 40e0) - 1, 0) + 0.5e0) as dist_bin, avg(value) as mean_value, count(value) as n
    from long_signed where signed_dist_um between -400 and 400 group by all having count(value) >= 20)
"""
