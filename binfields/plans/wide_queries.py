"""Queries on a lattice that grows with the tables: one slab of bins for every 6,000 order keys, so many tiles at any larger scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.operators import fields, grid, interface, neighbors, potts
from binfields.operators.grid import CELL
from binfields.plans import fixture as fx
from binfields.plans.fixture import ORACLE_SQL, QUERIES, rounded
from binfields.plans.space_queries import pairs
from binfields.sources.scratch import checkpoint

_WIDE_SQL = """, wide_binned as (
    select cast(floor((400e0 * u * u + 410e0 * slab) / 10e0) as integer) as x_bin, cast(floor(y / 10e0) as integer) as y_bin, z, slab
    from (select u, slab, 16e-2 * date_diff('day', date '1995-01-02', cast(l_shipdate as date)) as y, 5e0 + 100e0 * l_discount + 6e0 * u as z
          from (select *, (l_extendedprice - 900e0) / 104100e0 as u, l_orderkey // 6000 as slab from lineitem where l_quantity >= 10))),
wide as (
    select *, case when x_bin < 60 then 'A' else 'B' end as region
    from (select x_bin, y_bin, count(*) as transcript_count, avg(z) as z_mean_um from wide_binned group by x_bin, y_bin) where transcript_count >= 2),
wide_boundary as (
    select distinct a.x_bin, a.y_bin from wide a join wide b on a.region <> b.region and abs(a.x_bin - b.x_bin) <= 3 and abs(a.y_bin - b.y_bin) <= 3
     and (a.x_bin - b.x_bin) * (a.x_bin - b.x_bin) + (a.y_bin - b.y_bin) * (a.y_bin - b.y_bin) <= 9)
"""


def wide(sql: str):
    """Registers a query with its SQL after the common tables and those of the wide lattice."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = fx.BASE_SQL.rstrip() + _WIDE_SQL + sql
        return f

    return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with two detections or more; regions A and B meet at one line, so most cells are far from it."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_quantity") >= 10)
    u, slab = (F.col("l_extendedprice") - 900.0) / 104100.0, F.floor(F.col("l_orderkey") / 6000)
    points = items.select(
        (400.0 * u * u + 410.0 * slab).alias("x_location"),
        (0.16 * F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-02").cast("date"))).alias("y_location"),
        (5.0 + 100.0 * F.col("l_discount") + 6.0 * u).alias("z_location"),
    )
    found = grid.min_count_filter(grid.cell_agg(grid.bin_points(points)), 2)
    return found.withColumn("region", F.when(F.col("x_bin") < 60, "A").otherwise("B"))


@wide("select x_bin, y_bin, transcript_count, round(z_mean_um, 6) as z_mean_um, region from wide")
def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells(spark, sf_dir))


@wide(f"select x_bin, y_bin, nx, ny, d2, cast(r as integer) as rank from (select *, row_number() over (partition by x_bin, y_bin order by d2, nx, ny) as r from {pairs(12, 'wide', 'wide')} where d2 > 0) where r <= 8")
def wide_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.knn_join(cells(spark, sf_dir)).select(*CELL, "nx", "ny", F.col("d2").cast("int").alias("d2"), "rank")


@wide("""select w.x_bin, w.y_bin, region, b.x_bin is not null as is_boundary, round(case when d2 = 0 then 0e0 when region = 'B' then -10 * sqrt(cast(d2 as double)) else 10 * sqrt(cast(d2 as double)) end, 6) as signed_dist_um
 from wide w join (select t.x_bin, t.y_bin, min((t.x_bin - b.x_bin) * (t.x_bin - b.x_bin) + (t.y_bin - b.y_bin) * (t.y_bin - b.y_bin)) as d2 from wide t cross join wide_boundary b group by t.x_bin, t.y_bin) n using (x_bin, y_bin)
 left join wide_boundary b on b.x_bin = w.x_bin and b.y_bin = w.y_bin""")
def wide_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbors.signed_distance(cells(spark, sf_dir), "B", "A")
    return rounded(found.select(*CELL, "region", "is_boundary", "signed_dist_um"))


@wide(f"""select x_bin, y_bin, r as radius_um, round(coalesce(n, 0) / (pi() * r * r), 9) as density from wide cross join (select unnest([40, 60, 80, 100, 120]) as r)
 left join (select x_bin, y_bin, r, count(*) as n from {pairs(12, 'wide', 'wide')} join (select unnest([40, 60, 80, 100, 120]) as r) on d2 > 0 and d2 <= r * r / 100e0 group by all) using (x_bin, y_bin, r)""")
def wide_radius_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.radius_density(cells(spark, sf_dir)), 9)


@wide(f"""select x_bin, y_bin, s as sigma_um, round(sum(w) / (2 * pi() * s * s), 6) as rho_sigma, count(*) as n_neighbor,
 round(sqrt(greatest(sum(w * z * z) / sum(w) - power(sum(w * z) / sum(w), 2), 0e0)), 5) as z_std_all_sigma
 from (select p.x_bin, p.y_bin, s, c.z_mean_um - 10e0 as z, n_count * exp(-5e-1 * d2 * 100 / (s * s)) as w from {pairs(9, 'wide', 'wide')} p join wide c on c.x_bin = p.nx and c.y_bin = p.ny
  join (select unnest([15e0, 30e0]) as s) on d2 * 100 <= 9 * s * s) group by x_bin, y_bin, s""")
def wide_sigma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.sigma_fields(cells(spark, sf_dir).withColumn("z_residual", F.col("z_mean_um") - 10.0), (15.0, 30.0))
    return rounded(rows.select(*CELL, "sigma_um", "rho_sigma", "n_neighbor", F.round("z_std_all_sigma", 5).alias("z_std_all_sigma")))


@wide("select count(*) as n_cells, cast(0 as bigint) as n_better, true as lower from wide")
def wide_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, how many have a label of less energy than the one that smoothing left them with, and whether the energy fell."""
    n = F.col("transcript_count")
    unary = F.array(*(F.abs(F.col("z_mean_um") - c) / 4.0 + (n % m) / float(m) for c, m in ((6.0, 7), (10.0, 5), (14.0, 3))))
    own = checkpoint(cells(spark, sf_dir).select(*CELL, unary.alias("unary")).withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int")))
    edges = checkpoint(neighbors.lattice_edges(own).withColumn("w", 1.0 / (1 + F.pmod(F.col("x_bin") + F.col("ny"), F.lit(3)))))
    smooth = checkpoint(potts.potts_icm(own, edges, 0.4, sweeps=30))
    better = potts.label_costs(smooth, edges, 0.4).filter(F.element_at("cost", F.col("label") + 1) > F.array_min("cost") + 1e-9)
    before = potts.potts_energy(edges, own.withColumn("label", F.col("label_raw")), 0.4).select(F.col("total_energy").alias("before"))
    after = potts.potts_energy(edges, smooth, 0.4).select(F.col("total_energy").alias("after"))
    counts = smooth.agg(F.count("*").alias("n_cells")).join(F.broadcast(better.agg(F.count("*").alias("n_better"))))
    return counts.join(F.broadcast(before)).join(F.broadcast(after)).select("n_cells", "n_better", (F.col("after") < F.col("before")).alias("lower"))
