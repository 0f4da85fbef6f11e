"""Queries over neighbourhoods, marker scores, regions and their interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.functions.scalar import distance_bin
from binfields.operators import fields, grid, interface, markers, neighbors
from binfields.operators.grid import CELL
from binfields.plans import fixture as fx
from binfields.plans.fixture import query, rounded

_PAIRS = """(select a.x_bin, a.y_bin, b.x_bin as nx, b.y_bin as ny, (a.x_bin - b.x_bin) * (a.x_bin - b.x_bin) + (a.y_bin - b.y_bin) * (a.y_bin - b.y_bin) as d2, b.transcript_count as n_count
 from {left} a join {right} b on b.x_bin between a.x_bin - {reach} and a.x_bin + {reach} and b.y_bin between a.y_bin - {reach} and a.y_bin + {reach})"""


def pairs(reach: int, left: str = "cells", right: str = "cells") -> str:
    return _PAIRS.format(reach=reach, left=left, right=right)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, cells = fx.counts(spark, sf_dir), fx.labelled(spark, sf_dir)
    members = markers.marker_members(fx.marker_groups(spark, sf_dir), counts)
    return markers.score_field_join(markers.marker_scores(counts, cells, members), cells, ["region"])


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.signed_distance(fx.labelled(spark, sf_dir), "B", "A")


def long_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir).select(*CELL, "signed_dist_um", F.col("z_mean_um").alias("z"), F.col("transcript_count").cast("double").alias("n"))
    return interface.unpivot_features(rows, ["z", "n"], [*CELL, "signed_dist_um"])


@query(f"select x_bin, y_bin, count(*) as n, cast(sum(n_count) as bigint) as total from {pairs(3)} where d2 <= 9 group by x_bin, y_bin")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).select(*CELL, "transcript_count")
    return neighbors.radius_join(cells, cells, 30.0).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("transcript_count").alias("total"))


@query(f"select x_bin, y_bin, nx, ny, d2, cast(r as integer) as rank from (select *, row_number() over (partition by x_bin, y_bin order by d2, nx, ny) as r from {pairs(12)} where d2 > 0) where r <= 8")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.knn_join(fx.cells(spark, sf_dir)).select(*CELL, "nx", "ny", F.col("d2").cast("int").alias("d2"), "rank")


_EDGES = "(select a.x_bin, a.y_bin, b.x_bin as nx, b.y_bin as ny, abs(a.z_mean_um - b.z_mean_um) as d from cells a join cells b on (b.x_bin - a.x_bin, b.y_bin - a.y_bin) in ((1, 0), (0, 1), (1, 1), (1, -1)))"


@query(f"select x_bin, y_bin, nx, ny from {_EDGES}")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.lattice_edges(fx.cells(spark, sf_dir))


_WEIGHTED = f"(select x_bin, y_bin, nx, ny, exp(-(d * d) / (tau * tau)) as w from {_EDGES}, (select median(d) as tau from {_EDGES} where d > 0))"


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).withColumn("features", F.array("z_mean_um"))
    return neighbors.edge_similarity(neighbors.lattice_edges(cells), cells)


@query(f"select x_bin, y_bin, nx, ny, round(w, 6) as w from {_WEIGHTED}")
def edge_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weighted_edges(spark, sf_dir))


@query("select x_bin, y_bin from boundary")
def boundary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.labelled(spark, sf_dir).filter("region <> ''")
    return neighbors.boundary_cells(both).select(*CELL)


@query("select x_bin, y_bin, cast(d2 as bigint) as d2 from nearest")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.labelled(spark, sf_dir).filter("region <> ''")
    return neighbors.nearest_boundary(both, neighbors.boundary_cells(both)).select(*CELL, "d2")


@query("select x_bin, y_bin, region, is_boundary, round(signed_dist_um, 6) as signed_dist_um from signed")
def signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signed(spark, sf_dir).select(*CELL, "region", "is_boundary", "signed_dist_um"))


@query("select x_bin, y_bin, -400 + 40 * (greatest(ceil((signed_dist_um + 400) / 40e0) - 1, 0) + 5e-1) as dist_bin from signed where signed_dist_um between -400 and 400")
def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir).select(*CELL, distance_bin(F.col("signed_dist_um"), -400.0, 400.0, 40.0).alias("dist_bin"))
    return rows.filter("dist_bin is not null")


@query("select count(*) filter (signed_dist_um between -150 and -30) as n_neg, count(*) filter (signed_dist_um between 30 and 150) as n_pos, count(*) filter (signed_dist_um between -60 and 60) as n_near from signed")
def distance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("signed_dist_um")
    windows = ((interface.NEG_WINDOW, "n_neg"), (interface.POS_WINDOW, "n_pos"), (interface.SLOPE_WINDOW, "n_near"))
    return signed(spark, sf_dir).agg(*(F.count_if(interface.in_window(d, w)).alias(n) for w, n in windows))


@query(f"select x_bin, y_bin, round(sum(n_count * exp(-5e-1 * d2 * 100 / (15e0 * 15e0))) / (2 * pi() * 15 * 15), 6) as rho from {pairs(4)} where d2 <= 2025e-2 group by x_bin, y_bin")
def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.kernel_density(fx.cells(spark, sf_dir), 15.0))


_PILOT = f"(select x_bin, y_bin, sum(n_count * exp(-5e-1 * d2 * 100 / (50e0 * 50e0))) / (2 * pi() * 50 * 50) as rho from {pairs(15)} where d2 <= 225 group by x_bin, y_bin)"


@query(f"select x_bin, y_bin, round(rho, 6) as rho from {_PILOT}")
def pilot_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.cells(spark, sf_dir).withColumn("z_residual", F.lit(0.0))
    return rounded(fields.sigma_fields(rows, [50.0]).select(*CELL, F.col("rho_sigma").alias("rho")))


@query(f"select x_bin, y_bin from {_PILOT} where rho >= (select quantile_cont(rho, 6e-1) from {_PILOT})")
def fit_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.operators.baseline import fit_region as region

    rows = fx.cells(spark, sf_dir).withColumn("z_residual", F.lit(0.0))
    return region(fields.sigma_fields(rows, [50.0]).withColumnRenamed("rho_sigma", "rho")).select(*CELL)


@query("select marker_group, feature_name, n_genes from members")
def marker_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.marker_members(fx.marker_groups(spark, sf_dir), fx.counts(spark, sf_dir)).select("marker_group", "feature_name", "n_genes")


@query("select x_bin, y_bin, marker_group, round(score, 6) as score from scores")
def marker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).drop("region"))


@query("select x_bin, y_bin, marker_group, round(score, 6) as score, x_um, y_um from scores join cells using (x_bin, y_bin)")
def score_coord_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(markers.score_coord_join(scored(spark, sf_dir).drop("region"), fx.cells(spark, sf_dir)))


@query("select x_bin, y_bin, marker_group, round(score, 6) as score, round(z_mean_um, 6) as z_mean_um from scores join cells using (x_bin, y_bin)")
def score_field_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(markers.score_field_join(scored(spark, sf_dir).drop("region"), fx.cells(spark, sf_dir), ["z_mean_um"]))


@query("select x_bin, y_bin, min(marker_group) as dominant_group from scores s where score = (select max(score) from scores t where t.x_bin = s.x_bin and t.y_bin = s.y_bin) group by x_bin, y_bin")
def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.dominant_group(scored(spark, sf_dir))


_MWU = """select marker_group, sum(mid) filter (region = 'A') - count(*) filter (region = 'A') * (count(*) filter (region = 'A') + 1) / 2e0 as u from
 (select *, rank() over (partition by marker_group order by score) + (count(*) over (partition by marker_group, score) - 1) / 2e0 as mid from (select marker_group, region, round(score, 9) as score from scores) where region in ('A', 'B')) group by marker_group"""


@query(f"select s.marker_group, count(*) filter (region = 'A') as n_a, round(avg(score) filter (region = 'A'), 6) as mean_a, round(median(score) filter (region = 'B'), 6) as median_b, round(any_value(u), 4) as u from scores s join ({_MWU}) m on s.marker_group = m.marker_group group by s.marker_group")
def marker_group_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    return rounded(markers.marker_group_test(rows).select("marker_group", "n_a", "mean_a", "median_b", F.round("u", 4).alias("u")))


@query("""select marker_group, cast(row_number() over (order by abs(d) desc, marker_group) as integer) as place from (select marker_group, (avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) as d
 from (select marker_group, case when region = 'A' then score end as a, case when region = 'B' then score end as b from scores) group by marker_group)""")
def effect_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from binfields.functions.summary import group_summary

    rows = markers.effect_rank(group_summary(scored(spark, sf_dir), ["marker_group"], "score", "region"))
    return rows.select("marker_group", F.row_number().over(Window.orderBy(F.desc("abs_d"), "marker_group")).alias("place"))


@query(f"""select x_bin, y_bin, r as radius_um, round(coalesce(n, 0) / (pi() * r * r), 9) as density from two cross join (select unnest([40, 60, 80, 100, 120]) as r)
 left join (select x_bin, y_bin, r, count(*) as n from {pairs(12, 'two', 'two')} join (select unnest([40, 60, 80, 100, 120]) as r) on d2 > 0 and d2 <= r * r / 100e0 group by all) using (x_bin, y_bin, r)""")
def radius_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.labelled(spark, sf_dir).filter("region <> ''")
    return rounded(interface.radius_density(both), 9)


_HETERO = f"""(select x_bin, y_bin, r as radius_um, 1 - sum(s * s) / (sum(s) * sum(s)) as h from (select p.x_bin, p.y_bin, r, marker_group, sum(score) as s from {pairs(12, 'two', 'two')} p
 join (select unnest([40, 60, 80, 100, 120]) as r) on d2 > 0 and d2 <= r * r / 100e0 join scores c on c.x_bin = p.nx and c.y_bin = p.ny group by all) group by x_bin, y_bin, r having sum(s) > 0)"""


@query(f"select x_bin, y_bin, radius_um, round(h, 6) as heterogeneity from {_HETERO}")
def radius_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.labelled(spark, sf_dir).filter("region <> ''")
    own = scored(spark, sf_dir).filter("region <> ''")
    return rounded(interface.radius_heterogeneity(both, own).filter("heterogeneity is not null"))


_RANKS = """select region, rank() over (partition by region order by {x}) + (count(*) over (partition by region, {x}) - 1) / 2e0 as rx, rank() over (partition by region order by {y}) + (count(*) over (partition by region, {y}) - 1) / 2e0 as ry,
 rank() over (partition by region order by {c}) + (count(*) over (partition by region, {c}) - 1) / 2e0 as rc from {rows}"""


@query("select region, count(*) as n, round(corr(rx, ry), 6) as rho from (" + _RANKS.format(x="z_mean_um", y="transcript_count", c="x_bin", rows="labelled") + ") group by region")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.functions.ranks import spearman as rho

    return rounded(rho(fx.labelled(spark, sf_dir), "z_mean_um", "transcript_count", ["region"]))


_LEFT = "select region, round(rx - (regr_slope(rx, rc) over w * (rc - avg(rc) over w) + avg(rx) over w), 9) as ex, round(ry - (regr_slope(ry, rc) over w * (rc - avg(rc) over w) + avg(ry) over w), 9) as ey from (" + _RANKS.format(x="z_mean_um", y="transcript_count", c="x_bin", rows="labelled") + ") window w as (partition by region)"


@query(f"""select region, count(*) as n, round(corr(a, b), 4) as partial_rho from (select region, rank() over (partition by region order by ex) + (count(*) over (partition by region, ex) - 1) / 2e0 as a,
 rank() over (partition by region order by ey) + (count(*) over (partition by region, ey) - 1) / 2e0 as b from ({_LEFT})) group by region""")
def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.functions.ranks import partial_spearman as rho

    return rounded(rho(fx.labelled(spark, sf_dir), "z_mean_um", "transcript_count", "x_bin", ["region"]), 4)


_DENSITY = f"""(select x_bin, y_bin, r as radius_um, coalesce(n, 0) as density from two cross join (select unnest([40, 60, 80, 100, 120]) as r)
 left join (select x_bin, y_bin, r, count(*) as n from {pairs(12, 'two', 'two')} join (select unnest([40, 60, 80, 100, 120]) as r) on d2 > 0 and d2 <= r * r / 100e0 group by all) using (x_bin, y_bin, r))"""
_AROUND = f"(select two.x_bin, two.y_bin, region, radius_um, z_mean_um as v, ln(1 + transcript_count) as c, density, round(h, 9) as h from two join {_DENSITY} using (x_bin, y_bin) left join {_HETERO} using (x_bin, y_bin, radius_um))"


def _ranked(measure: str) -> str:
    """Spearman and partial Spearman of the value and a measure, for each radius and region."""

    def mid(column: str) -> str:
        return f"rank() over (partition by radius_um, region order by {column}) + (count(*) over (partition by radius_um, region, {column}) - 1) / 2e0"

    ranks = f"(select radius_um, region, {mid('v')} as rx, {mid(measure)} as ry, {mid('c')} as rc from {_AROUND} where {measure} is not null)"
    left = f"(select radius_um, region, rx, ry, round(rx - (regr_slope(rx, rc) over w * (rc - avg(rc) over w) + avg(rx) over w), 9) as ex, round(ry - (regr_slope(ry, rc) over w * (rc - avg(rc) over w) + avg(ry) over w), 9) as ey from {ranks} window w as (partition by radius_um, region))"
    return f"(select radius_um, region, count(*) as n, corr(rx, ry) as rho, corr(a, b) as partial_rho from (select *, {mid('ex')} as a, {mid('ey')} as b from {left}) group by radius_um, region having count(*) >= 20)"


@query(f"""select cast(d.radius_um as integer) as radius_um, d.region, round(d.rho, 4) as rho_z_density, round(d.partial_rho, 3) as partial_rho_z_density, round(h.rho, 4) as rho_z_heter_soft, round(h.partial_rho, 3) as partial_rho_z_heter_soft
 from {_ranked('density')} d left join {_ranked('h')} h on h.radius_um = d.radius_um and h.region = d.region""")
def radius_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.labelled(spark, sf_dir).filter("region <> ''")
    own = scored(spark, sf_dir).filter("region <> ''")
    soft = interface.radius_heterogeneity(both, own).withColumn("heterogeneity", F.round("heterogeneity", 9))
    found = interface.radius_sweep(both, interface.radius_density(both), soft, "z_mean_um")
    return found.select("radius_um", "region", *(F.round(c, 3 if c.startswith("partial") else 4).alias(c) for c in found.columns[2:]))


@query("select feature, dist_bin, round(mean_value, 6) as mean_value, n from profile")
def distance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.distance_profile(long_signed(spark, sf_dir)))


_ZSCORES = "(select *, (mean_value - avg(mean_value) over (partition by feature)) / nullif(stddev_samp(mean_value) over (partition by feature), 0) as zscore from profile)"


@query(f"select feature, dist_bin, round(zscore, 6) as zscore from {_ZSCORES}")
def profile_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.profile_zscore(interface.distance_profile(long_signed(spark, sf_dir))).select("feature", "dist_bin", "zscore"))


_GRADIENT = "(select feature, case when count(*) >= 3 then max(abs(g)) end as grad from (select feature, (mean_value - lag(mean_value) over w) / (dist_bin - lag(dist_bin) over w) as g from profile window w as (partition by feature order by dist_bin)) group by feature)"


@query(f"select feature, round(grad, 6) as grad_max_abs_per_um from {_GRADIENT}")
def profile_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.profile_gradient(interface.distance_profile(long_signed(spark, sf_dir))))


@query("select feature, dist_bin as peak_bin from profile qualify row_number() over (partition by feature order by mean_value desc, dist_bin) = 1")
def peak_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interface.peak_order(interface.distance_profile(long_signed(spark, sf_dir)), "mean_value").select("feature", "peak_bin")


@query(f"select feature, dist_bin, round(zscore, 6) as zscore, n, peak_bin from {_ZSCORES} join (select feature, dist_bin as peak_bin from profile qualify row_number() over (partition by feature order by mean_value desc, dist_bin) = 1) using (feature)")
def interface_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.interface_heatmap(long_signed(spark, sf_dir)).select("feature", "dist_bin", "zscore", "n", "peak_bin"))


_SLOPE = "(select feature, regr_slope(value, signed_dist_um) as slope from long_signed where signed_dist_um between -60 and 60 group by feature having count(*) >= 30)"


@query(f"select feature, round(slope, 6) as slope_near0_per_um from {_SLOPE}")
def slope_near_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = interface.slope_near_zero(F.col("value"), F.col("signed_dist_um"))
    return rounded(long_signed(spark, sf_dir).groupBy("feature").agg(slope.alias("slope_near0_per_um")))


_AUC = """(select feature, (sum(mid) filter (side = 1) - count(*) filter (side = 1) * (count(*) filter (side = 1) + 1) / 2e0) / (count(*) filter (side = 1) * count(*) filter (side = 0)) as auc from
 (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2e0 as mid from (select *, case when signed_dist_um >= 30 then 1 else 0 end as side from long_signed where abs(signed_dist_um) >= 30)) group by feature)"""


@query(f"select feature, round(auc, 6) as auc_sep_pos_vs_neg from {_AUC}")
def auc_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_signed(spark, sf_dir)
    return rounded(interface.auc_separation(rows))


_METRICS = f"""select feature, (avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) as contrast, count(*) as n_total, count(b) as n_neg_window, count(a) as n_pos_window,
 count(*) filter (signed_dist_um between -60 and 60) as n_slope_window from (select *, case when signed_dist_um between 30 and 150 then value end as a, case when signed_dist_um between -150 and -30 then value end as b from long_signed) group by feature"""


@query(f"""select feature, round(contrast, 6) as contrast_d_pos_minus_neg, round(slope, 6) as slope_near0_per_um, n_total, n_neg_window, n_pos_window, n_slope_window, round(grad, 6) as grad_max_abs_per_um, round(auc, 6) as auc_sep_pos_vs_neg
 from ({_METRICS}) left join {_SLOPE} using (feature) left join {_GRADIENT} using (feature) left join {_AUC} using (feature)""")
def interface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.interface_metrics(long_signed(spark, sf_dir)))


@query(f"select feature, round(grad, 6) as grad_max_abs_per_um from {_GRADIENT}")
def metric_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interface.metric_rank(interface.interface_metrics(long_signed(spark, sf_dir))).select("feature", "grad_max_abs_per_um"))


@query("select x_bin, y_bin, coalesce(l, -1) as label, coalesce('Cluster ' || l, 'Unassigned') as region from all_cells left join (select x_bin, y_bin, cluster_sorted as l from labelled) using (x_bin, y_bin)")
def labels_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.operators.potts import labels_writeback as write_back

    every = grid.cell_agg(fx.binned(spark, sf_dir)).select(*CELL)
    own = fx.labelled(spark, sf_dir).select(*CELL, F.col("cluster_sorted").alias("label"))
    return write_back(every, own).withColumn("region", grid.region_label(F.col("label")))
