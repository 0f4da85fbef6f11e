"""Queries over the multi-scale fields, the baseline, the mixture and the smoothing of its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.operators import baseline, dge, fields, mixture, potts
from binfields.operators.grid import CELL
from binfields.plans import fixture as fx
from binfields.plans.fixture import A, B, normal_sql, query, rounded
from binfields.plans.jobs import cell_fields, interface_job, scale_labels, segmentation, sigma_lambda_matrix, sigma_lambda_table
from binfields.plans.space_queries import _WEIGHTED, pairs, weighted_edges
from binfields.sources.scratch import checkpoint

_GIVEN = """(select x_bin, y_bin, cluster_sorted as label, transcript_count, [1e0 + abs(cluster_sorted - 0) + (transcript_count % 7) / 7e0, 1e0 + abs(cluster_sorted - 1) + (transcript_count % 5) / 5e0, 1e0 + abs(cluster_sorted - 2) + (transcript_count % 3) / 3e0] as unary from labelled)"""
_CUT = f"(select e.*, a.label as la, b.label as lb from {_WEIGHTED} e join {_GIVEN} a on a.x_bin = e.x_bin and a.y_bin = e.y_bin join {_GIVEN} b on b.x_bin = e.nx and b.y_bin = e.ny)"


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a given label and given energies."""
    k, n = F.col("cluster_sorted"), F.col("transcript_count")
    unary = F.array(*(1.0 + F.abs(k - j) + (n % m) / float(m) for j, m in ((0, 7), (1, 5), (2, 3))))
    return fx.labelled(spark, sf_dir).select(*CELL, k.alias("label"), n, unary.alias("unary"))


def with_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).withColumn("z_residual", F.col("z_mean_um") - 10.0)


_NEAR = f"(select p.x_bin, p.y_bin, s, c.z_mean_um - 10e0 as z, n_count * exp(-5e-1 * d2 * 100 / (s * s)) as w from {pairs(13)} p join cells c on c.x_bin = p.nx and c.y_bin = p.ny join (select unnest([15e0, 30e0, 45e0]) as s) on d2 * 100 <= 9 * s * s)"
_SORTED = f"(select *, sum(w) over (partition by x_bin, y_bin, s order by z) as cum, sum(w) over (partition by x_bin, y_bin, s) as total from {_NEAR})"
_MEDIANS = f"(select x_bin, y_bin, s, min(z) filter (cum >= 5e-1 * total) as med, min(z) filter (cum >= total / 3e0) as q1, min(z) filter (cum >= total * 2e0 / 3e0) as q2 from {_SORTED} group by x_bin, y_bin, s)"


def _variance_sql(which: str = "true") -> str:
    """Weighted population variance of the neighbours in one half."""
    w = f"sum(w) filter ({which})"
    return f"greatest(sum(w * z * z) filter ({which}) / {w} - power(sum(w * z) filter ({which}) / {w}, 2), 0e0)"


@query(f"""select x_bin, y_bin, sigma_um, round(total / (2 * pi() * sigma_um * sigma_um), 6) as rho_sigma, n_neighbor, n_up, n_low,
 round(sqrt(every), 5) as z_std_all_sigma, round(sqrt(u), 5) as z_std_up_sigma, round(sqrt(l), 5) as z_std_low_sigma, round(sqrt(u) - sqrt(l), 5) as z_std_diff_sigma, round(mixing, 6) as mixing_sigma from (
 select *, least(n_up / 8e0, 1) * coalesce(up, prior) + (1 - least(n_up / 8e0, 1)) * prior as u, least(n_low / 8e0, 1) * coalesce(low, prior) + (1 - least(n_low / 8e0, 1)) * prior as l from (
  select x_bin, y_bin, s as sigma_um, sum(w) as total, count(*) as n_neighbor, count(*) filter (z >= med) as n_up, count(*) filter (z < med) as n_low, {_variance_sql()} as every, {_variance_sql('z >= med')} as up, {_variance_sql('z < med')} as low,
   case when any_value(q2) > any_value(q1) then 1 - (power(coalesce(sum(w) filter (z < q1), 0) / sum(w), 2) + power(coalesce(sum(w) filter (z >= q1 and z < q2), 0) / sum(w), 2) + power(coalesce(sum(w) filter (z >= q2), 0) / sum(w), 2)) end as mixing
  from {_NEAR} join {_MEDIANS} using (x_bin, y_bin, s) group by x_bin, y_bin, s), (select greatest(var_pop(z_mean_um - 10e0), 1e-6) as prior from cells))""")
def sigma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    spreads = [F.round(f"z_std_{n}_sigma", 5).alias(f"z_std_{n}_sigma") for n in ("all", "up", "low", "diff")]
    rows = fields.sigma_fields(with_residual(spark, sf_dir))
    return rounded(rows.select(*CELL, "sigma_um", "rho_sigma", "n_neighbor", "n_up", "n_low", *spreads, "mixing_sigma"))


_AXIS = "select distinct {a}_bin, " + f"{normal_sql('(hi - {a}_um) / 30e0')} + {normal_sql('({a}_um - lo) / 30e0')} - 1" + " as share from cells, (select min({a}_um) as lo, max({a}_um) as hi from cells)"


@query(f"select x_bin, y_bin, round(least(greatest(sx.share * sy.share, 1e-3), 1e0), 8) as corr from cells join ({_AXIS.format(a='x')}) sx using (x_bin) join ({_AXIS.format(a='y')}) sy using (y_bin)")
def edge_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.edge_correction(fx.cells(spark, sf_dir), 30.0).select(*CELL, "corr"), 8)


@query("""select x_bin, y_bin, round(5e-1 * raw + 5e-1 * (row_number() over (order by raw, x_bin, y_bin) - 1) / (count(*) over () - 1), 5) as confidence_weight from (
 select x_bin, y_bin, round(least(sqrt(n / nb), 1) * least(sqrt(h / hf), 1), 9) as raw from (select x_bin, y_bin, transcript_count % 90 + 1 as n, least(transcript_count % 40, transcript_count % 30) + 1 as h from cells),
 (select quantile_cont(transcript_count % 90 + 1, 9e-1) as nb, quantile_cont(least(transcript_count % 40, transcript_count % 30) + 1, 9e-1) as hf from cells))""")
def confidence_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("transcript_count")
    rows = fx.cells(spark, sf_dir).select(*CELL, (n % 90 + 1).alias("n_neighbor"), (n % 40 + 1).alias("n_up"), (n % 30 + 1).alias("n_low"))
    return rounded(fields.confidence_weight(rows).select(*CELL, "confidence_weight"), 5)


@query("select x_bin, y_bin, 15e0 as sigma_um, transcript_count as n from cells union all select x_bin, y_bin, 30e0, transcript_count from cells union all select x_bin, y_bin, 45e0, transcript_count from cells")
def union_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, out = fx.cells(spark, sf_dir), None
    for s in fields.SIGMAS:
        own = cells.select(*CELL, F.lit(s).alias("sigma_um"), F.col("transcript_count").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def surfaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict, dict]:
    cells = checkpoint(fx.cells(spark, sf_dir))
    density = fields.kernel_density(cells, 15.0)
    region = checkpoint(cells.join(baseline.fit_region(density).select(*CELL), list(CELL), "left_semi"))
    return cells, region, baseline.baseline_surface(region, "linear"), baseline.baseline_surface(region, "quadratic", seed=baseline.SEED + 1)


@query()
def baseline_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, linear, quadratic = surfaces(spark, sf_dir)
    rows = [(s["order"], s["aic"], [float(c) for c in s["coefficients"]]) for s in (linear, quadratic)]
    return spark.createDataFrame(rows, "`order` string, aic double, coefficients array<double>")


_SURFACE = {"order": "linear", "centre": {"x_mean": 100.0, "x_std": 50.0, "y_mean": 200.0, "y_std": 100.0}, "coefficients": [11.0, 1.0, 0.25], "inlier_plane": [11.0, 1.0, 0.25], "inlier_limit": 1.0, "aic": 0.0}


@query("""select x_bin, y_bin, round(b, 6) as z_baseline, round(z_mean_um - b, 6) as z_residual, case when x_bin < 20 then cast(transcript_count as double) else 0 end as baseline_fit_weight,
 case when x_bin < 20 and abs(z_mean_um - b) <= 1 then 1 else 0 end as baseline_inlier from (select *, 11e0 + (x_um - 100) / 50e0 + 25e-2 * (y_um - 200) / 100e0 as b from cells)""")
def baseline_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir)
    rows = baseline.baseline_residual(cells, _SURFACE, cells.filter("x_bin < 20"))
    return rounded(rows.select(*CELL, "z_baseline", "z_residual", "baseline_fit_weight", "baseline_inlier"))


_MORAN = f"""(select sum(p) / (select sum(z * z) from (select z_mean_um - (select avg(z_mean_um) from cells) as z from cells)) as i from (
 select x_bin, y_bin, avg(za * zb) as p from (select k.x_bin, k.y_bin, a.z_mean_um - m as za, b.z_mean_um - m as zb from (select *, row_number() over (partition by x_bin, y_bin order by d2, nx, ny) as r from {pairs(12)} where d2 > 0) k
 join cells a on a.x_bin = k.x_bin and a.y_bin = k.y_bin join cells b on b.x_bin = k.nx and b.y_bin = k.ny, (select avg(z_mean_um) as m from cells) where r <= 8) group by x_bin, y_bin))"""


@query(f"select round(i, 6) as moran_i from {_MORAN}")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.morans_i(fx.cells(spark, sf_dir), "z_mean_um"))


@query()
def moran_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = checkpoint(fx.cells(spark, sf_dir))
    p = baseline.moran_p(cells, "z_mean_um")
    return baseline.morans_i(cells, "z_mean_um").withColumn("p", F.lit(p)).withColumn("trend", F.lit(p < 0.01) & (F.abs("moran_i") >= 0.03))


_KNN = f"(select x_bin, y_bin, nx, ny, 1e0 / count(*) over (partition by x_bin, y_bin) as w from (select *, row_number() over (partition by x_bin, y_bin order by d2, nx, ny) as r from {pairs(12)} where d2 > 0) where r <= 8)"


@query(f"""select round(i, 6) as moran_i, round(-1 / (n - 1), 9) as mean, round((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * n * n) - n * z4 / (z2 * z2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * n * n)) / ((n - 1) * (n - 2) * (n - 3) * n * n) - 1 / ((n - 1) * (n - 1)), 9) as variance
 from {_MORAN}, (select cast(count(*) as double) as n, sum(power(z, 2)) as z2, sum(power(z, 4)) as z4 from (select z_mean_um - avg(z_mean_um) over () as z from cells)),
 (select sum(t * t) as s1 from (select sum(w) as t from {_KNN} group by least((x_bin, y_bin), (nx, ny)), greatest((x_bin, y_bin), (nx, ny)))),
 (select sum((1 + coalesce(t, 0)) * (1 + coalesce(t, 0))) as s2 from cells left join (select nx as x_bin, ny as y_bin, sum(w) as t from {_KNN} group by nx, ny) using (x_bin, y_bin))""")
def moran_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.moran_moments(fx.cells(spark, sf_dir), "z_mean_um"), 9).withColumn("moran_i", F.round("moran_i", 6))


@query("select x_bin, y_bin, case when abs(z_mean_um - 10e0) >= (select quantile_cont(abs(z_mean_um - 10e0), 75e-2) from cells) then 7e-1 else 1e0 end as local_scale from cells")
def trend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.trend_guard(with_residual(spark, sf_dir), True).select(*CELL, "local_scale")


@query("select x_bin, y_bin, round((z_mean_um - avg(z_mean_um) over ()) / stddev_pop(z_mean_um) over (), 6) as a, round((transcript_count - avg(transcript_count) over ()) / stddev_pop(transcript_count) over (), 6) as b from cells")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.standardize(fx.cells(spark, sf_dir), ["z_mean_um", "transcript_count"])
    return rounded(rows.select(*CELL, F.col("features")[0].alias("a"), F.col("features")[1].alias("b")))


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.cells(spark, sf_dir).withColumn("log_count", F.log1p("transcript_count"))
    return checkpoint(mixture.standardize(rows, ["z_mean_um", "log_count"]))


@query()
def gmm_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = mixture.gmm_diag(standardized(spark, sf_dir), 3)
    rows = [(k, float(model["weights"][k]), model["means"][k].tolist(), model["variances"][k].tolist(), float(model["bic"]), float(model["icl"])) for k in range(3)]
    return spark.createDataFrame(rows, "component int, weight double, means array<double>, variances array<double>, bic double, icl double")


@query()
def k_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = standardized(spark, sf_dir)
    ks = tuple(range(2, 9))
    stability = mixture.k_stability(cells, ks)
    models = mixture.fit_mixtures(cells, [(k, 1.0) for k in ks])
    return spark.createDataFrame([(k, float(m["bic"]), float(m["icl"]), stability.get(k)) for k, m in zip(ks, models, strict=True)], "k int, bic double, icl double, stability double")


@query("select cast(y_bin as integer) as k from (select y_bin, avg(z_mean_um) as icl, (count(*) % 10) / 10e0 as stability from cells group by y_bin) order by case when stability >= 7e-1 then 0 else 1 end, case when stability >= 7e-1 then icl end, stability desc, k limit 1")
def select_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fx.cells(spark, sf_dir).groupBy(F.col("y_bin").alias("k")).agg(F.avg("z_mean_um").alias("icl"), ((F.count("*") % 10) / 10.0).alias("stability"))
    return mixture.select_k(table).select("k")


_POSTERIOR = "(select x_bin, y_bin, (transcript_count % 100) / 100e0 as conf, [-ln(a / (a + b + c) + 1e-12), -ln(b / (a + b + c) + 1e-12), -ln(c / (a + b + c) + 1e-12)] as d from (select *, 1e0 + transcript_count % 7 as a, 1e0 + transcript_count % 5 as b, 1e0 + transcript_count % 3 as c from cells))"


@query(f"select x_bin, y_bin, round(u[1], 6) as u0, round(u[2], 6) as u1, round(u[3], 6) as u2, cast(list_position(list_transform(u, lambda x: round(x, 9)), round(list_min(u), 9)) - 1 as integer) as label_raw from (select x_bin, y_bin, list_transform(d, lambda x: conf * x + (1 - conf) * list_sum(d) / 3) as u from {_POSTERIOR})")
def unary_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("transcript_count")
    parts = [1.0 + n % 7, 1.0 + n % 5, 1.0 + n % 3]
    rows = fx.cells(spark, sf_dir).withColumn("posterior", F.array(*(p / (parts[0] + parts[1] + parts[2]) for p in parts))).withColumn("confidence_weight", (n % 100) / 100.0)
    made = potts.unary_energy(rows).withColumn("_u", F.transform("unary", lambda x: F.round(x, 9)))
    first = (F.array_position("_u", F.array_min("_u")) - 1).cast("int")
    return rounded(made.select(*CELL, *(F.col("unary")[k].alias(f"u{k}") for k in range(3)), first.alias("label_raw")))


@query(f"select round(median(g), 6) as lambda0 from (select list_sort(unary)[2] - list_sort(unary)[1] as g from {_GIVEN}) where g > 0")
def unary_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(potts.unary_margin(given(spark, sf_dir)))


@query(f"select round(sum(case when la <> lb then w else 0 end) / sum(w), 6) as boundary_ratio from {_CUT}")
def boundary_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(potts.boundary_ratio(weighted_edges(spark, sf_dir), given(spark, sf_dir)))


@query(f"select round(d, 4) as data_energy, round(s, 4) as smooth_energy, round(d + s, 4) as total_energy from (select sum(unary[label + 1]) as d from {_GIVEN}), (select sum(case when la <> lb then w else 0 end) * 5e-1 as s from {_CUT})")
def potts_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(potts.potts_energy(weighted_edges(spark, sf_dir), given(spark, sf_dir), 0.5), 4)


@query(f"""select x_bin, y_bin, round(unary[label + 1], 6) as data_energy, round(coalesce(s, 0), 6) as smooth_energy, round(unary[label + 1] + coalesce(s, 0), 6) as total_energy from {_GIVEN} left join (
 select x_bin, y_bin, sum(cut) as s from (select x_bin, y_bin, case when la <> lb then 25e-2 * w else 0 end as cut from {_CUT} union all select nx, ny, case when la <> lb then 25e-2 * w else 0 end from {_CUT}) group by x_bin, y_bin) using (x_bin, y_bin)""")
def cell_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = potts.cell_energies(given(spark, sf_dir), weighted_edges(spark, sf_dir), 0.5)
    return rounded(rows.select(*CELL, "data_energy", "smooth_energy", "total_energy"))


@query(f"""select round(avg(-e[label + 1] - ln(list_sum(list_transform(e, lambda x: exp(-x))))), 6) as pseudo_likelihood from (
 select label, list_transform([1, 2, 3], lambda k: unary[k] + 5e-1 * (coalesce(total, 0) - coalesce(case k when 1 then v0 when 2 then v1 else v2 end, 0))) as e from {_GIVEN} left join (
  select x_bin, y_bin, sum(w) as total, sum(w) filter (l = 0) as v0, sum(w) filter (l = 1) as v1, sum(w) filter (l = 2) as v2 from (select x_bin, y_bin, w, lb as l from {_CUT} union all select nx, ny, w, la from {_CUT}) group by x_bin, y_bin) using (x_bin, y_bin))""")
def pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(potts.pseudo_likelihood(given(spark, sf_dir), weighted_edges(spark, sf_dir), 0.5))


def _icm_sql(lam: str, sweeps: int) -> str:
    """Sweeps over the four cell colours, one common table for each move of a colour."""
    steps = []
    for i in range(4 * sweeps):
        ox, oy = i % 4 // 2, i % 2
        mine = f"((x_bin % 2) + 2) % 2 = {ox} and ((y_bin % 2) + 2) % 2 = {oy}"
        costs = ", ".join(f"unary[{k + 1}] + {lam} * (coalesce(total, 0) - coalesce(v{k}, 0))" for k in range(3))
        votes = f"select e.x_bin, e.y_bin, sum(w) as total, {', '.join(f'sum(w) filter (label = {k}) as v{k}' for k in range(3))} from both_ends e join s{i} s on s.x_bin = e.nx and s.y_bin = e.ny group by e.x_bin, e.y_bin"
        steps.append(f"""s{i + 1} as materialized (
 select x_bin, y_bin, label_raw, unary, cast(case when {mine} and c[label + 1] > list_min(c) then list_position(c, list_min(c)) - 1 else label end as integer) as label
 from (select *, [{costs}] as c from s{i} left join ({votes}) using (x_bin, y_bin)))""")
    return f"""select * from (with edges as materialized (select * from {_WEIGHTED}), both_ends as materialized (select x_bin, y_bin, nx, ny, w from edges union all select nx, ny, x_bin, y_bin, w from edges),
s0 as materialized (select x_bin, y_bin, cast(list_position(unary, list_min(unary)) - 1 as integer) as label_raw, unary, cast(list_position(unary, list_min(unary)) - 1 as integer) as label from {_GIVEN}),
{", ".join(steps)}
select x_bin, y_bin, label_raw, label from s{4 * sweeps})"""


@query(_icm_sql("5e-1", 10))
def potts_icm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir).withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int")).drop("label")
    return potts.potts_icm(rows, checkpoint(weighted_edges(spark, sf_dir)), 0.5).select(*CELL, "label_raw", "label")


@query()
def lambda_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(given(spark, sf_dir).withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int")).drop("label"))
    return potts.lambda_stability(rows, checkpoint(weighted_edges(spark, sf_dir)), [0.5])


@query("""select "lambda" from (select y_bin / 10e0 as "lambda", avg(z_mean_um) / 100 as br, -avg(transcript_count) / 100 as pl, (count(*) % 10) / 10e0 as st from cells group by y_bin) order by st - 1e-1 * br desc, pl - 1e-1 * br desc, "lambda" limit 1""")
def select_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fx.cells(spark, sf_dir).groupBy((F.col("y_bin") / 10.0).alias("lambda")).agg(
        (F.avg("z_mean_um") / 100).alias("boundary_ratio"), (-F.avg("transcript_count") / 100).alias("pseudo_likelihood"), ((F.count("*") % 10) / 10.0).alias("stability")
    )
    return potts.select_lambda(table)


@query(f"select x_bin, y_bin, nx, ny from {_WEIGHTED} where x_bin % 3 <> 0 and nx % 3 <> 0")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_edges(spark, sf_dir).filter("x_bin % 3 <> 0 and nx % 3 <> 0").select(*CELL, "nx", "ny")


def _unit_sql(seed: int, x: str, y: str) -> str:
    """The operators' hash of a cell as a number in (0, 1)."""
    return f"((cast('0x' || substr(md5('{seed}:' || {x} || ':' || {y}), 1, 13) as bigint) + 5e-1) / {2**52})"


_KEPT = [f"{_unit_sql(baseline.SEED + 1, *ends)} < 8e-1" for ends in (("x_bin", "y_bin"), ("nx", "ny"))]


@query(f"select x_bin, y_bin, nx, ny, round(w, 6) as w from {_WEIGHTED} where {_KEPT[0]} and {_KEPT[1]}")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(potts.induced_subgraph(weighted_edges(spark, sf_dir), 0.8, 1).select(*CELL, "nx", "ny", "w"))


@query(f"select x_bin, y_bin from cells where {_KEPT[0]} and {_unit_sql(baseline.SEED + 2, 'x_bin', 'y_bin')} < 8e-1")
def subsample_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).select(*CELL)
    return potts.subsample(cells, 0.8, 1).join(potts.subsample(cells, 0.8, 2), list(CELL))


_CELL_HASH = _unit_sql(baseline.SEED, "x_bin", "y_bin")


@query(f"select x_bin, y_bin, transcript_count from cells order by {_CELL_HASH}, x_bin, y_bin limit 500")
def uniform_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.uniform_subsample(fx.cells(spark, sf_dir), 500).select(*CELL, "transcript_count")


@query(f"select x_bin, y_bin, transcript_count from cells order by -ln({_CELL_HASH}) / transcript_count, x_bin, y_bin limit 500")
def weighted_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.weighted_subsample(fx.cells(spark, sf_dir), 500).select(*CELL, "transcript_count")


@query()
def cell_fields_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_fields(fx.cells(spark, sf_dir))


@query()
def segmentation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation(cell_fields(fx.cells(spark, sf_dir)))


@query()
def sigma_lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma_lambda_table(cell_fields(fx.cells(spark, sf_dir)))


@query()
def sigma_lambda_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability, boundary ratio and objective, each as a matrix: a row for each scale, a column for each factor of the weight."""
    table = checkpoint(sigma_lambda_table(cell_fields(fx.cells(spark, sf_dir))))
    out = None
    for value in ("stability", "boundary_ratio", "objective"):
        one = sigma_lambda_matrix(table, value).select(F.lit(value).alias("value"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def smoothed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(given(spark, sf_dir).withColumn("label_raw", (F.array_position("unary", F.array_min("unary")) - 1).cast("int")).drop("label"))
    return potts.smoothed(rows, checkpoint(weighted_edges(spark, sf_dir)), [0.25, 0.5, 1.0]).select("lambda", *CELL, "label_raw", "label")


@query()
def multiscale_dge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scale clustered anew on its own fields."""
    scales = scale_labels(cell_fields(fx.cells(spark, sf_dir)), k=4)
    plain = checkpoint(fx.counts(spark, sf_dir).drop("cluster_sorted", "lib_size", "cpm"))
    return dge.multiscale_dge(plain, scales, A, B).select("sigma_um", "feature_name", "log2FC", "u", "z", "pval", "qval", "significance_score", "vis_size")


@query()
def marker_interface_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface metrics of the marker scores and of two columns of the cells."""
    cells, counts = checkpoint(fx.labelled(spark, sf_dir)), checkpoint(fx.counts(spark, sf_dir))
    return interface_job(cells, counts, fx.marker_groups(spark, sf_dir), "B", "A", ["z_mean_um", "transcript_count"])["metrics"]
