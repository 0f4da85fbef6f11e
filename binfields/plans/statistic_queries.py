"""Queries over aggregates, windows, ranks, correlations and differential abundance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binfields.functions import ranks, scalar, summary
from binfields.operators import dge, enrichment
from binfields.operators.grid import CELL
from binfields.operators.potts import top_per_group
from binfields.plans import fixture as fx
from binfields.plans.fixture import A, B, ORACLE_SQL, QUERIES, query, rounded
from binfields.sources.scratch import checkpoint


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A against B with exp(-10 z) in the place of p, which SQL has too."""
    counts = fx.counts(spark, sf_dir)
    rows = dge.pairwise_dge(counts, fx.labelled(spark, sf_dir), A, B)
    return dge.dge_flags(ranks.bh_fdr(rows.drop("qval").withColumn("pval", F.exp(-10 * F.col("z"))), "pval"))


@query("""select feature_name, cluster_sorted, round(avg(cpm), 6) as mean_cpm, round(avg(ln(1 + cpm)), 6) as mean_log1p, round(avg(case when count > 0 then 1e0 else 0 end), 6) as pct
 from dense group by feature_name, cluster_sorted""")
def mean_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dge.gene_means(fx.counts(spark, sf_dir), fx.labelled(spark, sf_dir), "cluster_sorted")
    return rounded(rows.drop("n_cells"))


@query("select feature_name, cluster_sorted, round(avg(case when count > 0 then 1e0 else 0 end), 6) as pct from dense group by feature_name, cluster_sorted")
def pct_expressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dge.gene_means(fx.counts(spark, sf_dir), fx.labelled(spark, sf_dir), "cluster_sorted")
    return rounded(rows.select("feature_name", "cluster_sorted", "pct"))


@query("select feature_name, round(log2FC, 6) as log2fc from pair_z")
def log2_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir).select("feature_name", F.col("log2FC").alias("log2fc")))


@query("select round(quantile_cont(z_mean_um, 9e-1), 6) as quantile from cells")
def global_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.global_quantile(fx.cells(spark, sf_dir), "z_mean_um", 0.9))


@query("select round(m, 6) as median, round(median(abs(z_mean_um - m)), 6) as mad from cells, (select median(z_mean_um) as m from cells) group by m")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.median_mad(fx.cells(spark, sf_dir), "z_mean_um"))


@query("select cluster_sorted, median(transcript_count) as median from labelled group by cluster_sorted")
def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.group_median(fx.labelled(spark, sf_dir), "cluster_sorted", "transcript_count")


@query("""select x_bin, y_bin, cast(r as integer) as label from labelled join
 (select cluster_sorted, row_number() over (order by median(transcript_count), cluster_sorted) - 1 as r from labelled group by cluster_sorted) using (cluster_sorted)""")
def relabel_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.relabel_by_median(fx.labelled(spark, sf_dir), "cluster_sorted", "transcript_count", "label")
    return rows.select(*CELL, "label")


_CONF = "(select x_bin, y_bin, z_mean_um - 10e0 as value, (transcript_count % 100) / 100e0 as conf from cells)"


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select(*CELL, (F.col("z_mean_um") - 10.0).alias("value"), ((F.col("transcript_count") % 100) / 100.0).alias("conf"))


@query(f"""select case when conf < 4e-1 then '[0,0.4)' when conf < 7e-1 then '[0.4,0.7)' when conf < 101e-2 then '[0.7,1.01)' else 'other' end as confidence_bin,
 count(value) as count, round(median(abs(value)), 6) as median, round(avg(abs(value)), 6) as mean from {_CONF} group by 1""")
def conf_bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.conf_bin_stats(_confident(spark, sf_dir), "value", "conf"))


@query(f"""select x_bin, y_bin, case when conf < 4e-1 then '[0,0.4)' when conf < 7e-1 then '[0.4,0.7)' when conf < 101e-2 then '[0.7,1.01)' else 'other' end as confidence_bin,
 case when conf <= 4e-1 then 'low' when conf <= 7e-1 then 'mid' else 'high' end as level from {_CONF}""")
def conf_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.col("conf")
    return _confident(spark, sf_dir).select(*CELL, scalar.conf_bins(conf).alias("confidence_bin"), scalar.conf_levels(conf).alias("level"))


_EXTREME = f"""select round(t, 6) as threshold, round(avg(hit), 6) as fraction_all, round(avg(case when conf < 4e-1 then hit end), 6) as fraction_low, round(avg(case when conf >= 7e-1 then hit end), 6) as fraction_high
 from (select *, case when abs(value) >= t then 1 else 0 end as hit from {_CONF}, (select quantile_cont(abs(value), 95e-2) as t from {_CONF})) group by t"""


@query(_EXTREME)
def extreme_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.extreme_fractions(_confident(spark, sf_dir), "value", "conf"))


@query(f"""select * from ({_EXTREME}) cross join
 (select case when conf < 4e-1 then '[0,0.4)' when conf < 7e-1 then '[0.4,0.7)' when conf < 101e-2 then '[0.7,1.01)' else 'other' end as confidence_bin, count(value) as count, round(median(abs(value)), 6) as median, round(avg(abs(value)), 6) as mean from {_CONF} group by 1)""")
def layer_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confident(spark, sf_dir)
    one = summary.extreme_fractions(rows, "value", "conf")
    return rounded(summary.conf_bin_stats(rows, "value", "conf").join(F.broadcast(one)))


_D = """case when count(a) >= 2 and count(b) >= 2 and ((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) > 0
 then (avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) end"""


@query(f"""select marker_group, round({_D}, 6) as cohens_d from (select marker_group, case when region = 'A' then score end as a, case when region = 'B' then score end as b from scores) group by marker_group""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.plans.space_queries import scored

    d = summary.cohens_d(F.col("score"), F.col("region") == "A", F.col("region") == "B")
    return rounded(scored(spark, sf_dir).groupBy("marker_group").agg(d.alias("cohens_d")))


@query(f"""select marker_group, count(a) as n_a, count(b) as n_b, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(median(a), 6) as median_a, round(median(b), 6) as median_b, round({_D}, 6) as cohens_d
 from (select marker_group, case when region = 'A' then score end as a, case when region = 'B' then score end as b from scores) group by marker_group""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.plans.space_queries import scored

    return rounded(summary.group_summary(scored(spark, sf_dir), ["marker_group"], "score", "region"))


@query("""select feature_name, round(sqrt(greatest(sum(count * z * z) / sum(count) - (sum(count * z) / sum(count)) * (sum(count * z) / sum(count)), 0)), 6) as spread
 from (select feature_name, count, z_mean_um - 10e0 as z from counts join cells using (x_bin, y_bin)) group by feature_name""")
def weighted_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.counts(spark, sf_dir).join(fx.cells(spark, sf_dir).select(*CELL, (F.col("z_mean_um") - 10.0).alias("z")), list(CELL))
    return rounded(rows.groupBy("feature_name").agg(summary.weighted_std(F.col("z"), F.col("count")).alias("spread")))


@query("""select feature_name, min(x_bin) as x_median from
 (select feature_name, x_bin, sum(w) over (partition by feature_name order by x_bin) as cum, sum(w) over (partition by feature_name) as total from (select feature_name, x_bin, sum(count) as w from counts group by all))
 where cum >= 5e-1 * total group by feature_name""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.weighted_quantile(fx.counts(spark, sf_dir), "x_bin", "count", ["feature_name"], 0.5, "x_median")


@query("""select x_bin, y_bin, cast(r + (t - 1) / 2e0 as double) as midrank from (select x_bin, y_bin, rank() over (order by transcript_count) as r, count(*) over (partition by transcript_count) as t from cells)""")
def midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.midrank(fx.cells(spark, sf_dir), "transcript_count").select(*CELL, F.col("midrank").cast("double").alias("midrank"))


@query("select feature_name, n1, n2, round(u, 6) as u, round(z, 6) as z from pair_z")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir).select("feature_name", "n1", "n2", "u", "z"))


@query("select feature_name, round((u / (n1 * n2) - 5e-1) * 2, 6) as score from pair_z")
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir).select("feature_name", "score"))


@query("""select o_orderkey, round(least(min(p * m / r) over (partition by o_orderpriority order by r desc rows between unbounded preceding and current row), 1), 6) as qval
 from (select *, row_number() over (partition by o_orderpriority order by p) as r, count(*) over (partition by o_orderpriority) as m
       from (select o_orderkey, o_orderpriority, case when o_orderkey % 17 = 0 then 1e0 else o_totalprice / 600000e0 end as p from orders))""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 600000.0).alias("p"))
    return rounded(ranks.bh_fdr(rows, "p", ["o_orderpriority"]).select("o_orderkey", "qval"))


@query("select x_bin, y_bin, round(5e-1 * raw + 5e-1 * (r - 1) / (n - 1), 6) as confidence_weight from (select x_bin, y_bin, raw, row_number() over (order by raw, x_bin, y_bin) as r, count(*) over () as n from (select x_bin, y_bin, (transcript_count % 100) / 100e0 as raw from cells))")
def confidence_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.operators.fields import confidence_rank_blend as blend

    return rounded(blend(_confident(spark, sf_dir), "conf").select(*CELL, "confidence_weight"))


_RANKED = """select *, rank() over (partition by feature_name order by cpm) + (count(*) over (partition by feature_name, cpm) - 1) / 2e0 as mid,
 cast(count(*) over (partition by feature_name, cpm) as double) as t from dense"""
_RANKING = f"""select feature_name, cluster_sorted, (r - n1 * (n1 + 1) / 2e0) / (n1 * n2) * 2 - 1 as score, log2((c_in + 1) / (c_out + 1)) as log2fc, pct, l_in as mean_log1p_in, l_out as mean_log1p_out, r - n1 * (n1 + 1) / 2e0 as u from (
 select feature_name, k.cluster_sorted, count(*) filter (d.cluster_sorted = k.cluster_sorted) as n1, count(*) filter (d.cluster_sorted <> k.cluster_sorted) as n2, sum(mid) filter (d.cluster_sorted = k.cluster_sorted) as r,
  avg(cpm) filter (d.cluster_sorted = k.cluster_sorted) as c_in, avg(cpm) filter (d.cluster_sorted <> k.cluster_sorted) as c_out, avg(ln(1 + cpm)) filter (d.cluster_sorted = k.cluster_sorted) as l_in,
  avg(ln(1 + cpm)) filter (d.cluster_sorted <> k.cluster_sorted) as l_out, avg(case when count > 0 then 1e0 else 0 end) filter (d.cluster_sorted = k.cluster_sorted) as pct
 from ({_RANKED}) d cross join (select distinct cluster_sorted from labelled) k group by all)"""


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dge.marker_ranking(fx.counts(spark, sf_dir), fx.labelled(spark, sf_dir))


@query(f"select feature_name, cluster_sorted, round(score, 6) as score, round(log2fc, 6) as log2fc, round(pct, 6) as pct, round(mean_log1p_in, 6) as mean_log1p_in, round(mean_log1p_out, 6) as mean_log1p_out, round(u, 6) as u from ({_RANKING})")
def marker_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking(spark, sf_dir).select("feature_name", "cluster_sorted", "score", "log2fc", "pct", "mean_log1p_in", "mean_log1p_out", "u"))


@query(f"select * from (select cluster_sorted, feature_name, cast(row_number() over (partition by cluster_sorted order by round(score, 9) desc, feature_name) as integer) as rank from ({_RANKING})) where rank <= 20")
def topn_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking(spark, sf_dir).withColumn("score", F.round("score", 9))
    return dge.topn_per_cluster(rows).select("cluster_sorted", "feature_name", "rank")


@query(f"""select cluster_sorted, feature_name || case when log2fc > 1 then ' [LFC>1.0]' else '' end || case when pct > 2e-1 then ' [PCT>0.2]' else '' end || case when 1 - abs(score) < 5e-2 then ' [FDR<0.05]' else '' end as line from ({_RANKING})""")
def marker_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking(spark, sf_dir).withColumn("fdr", 1 - F.abs("score"))
    return rows.select("cluster_sorted", dge.marker_text().alias("line"))


@query("select feature_name, round(cpm_a, 6) as cpm_a, round(cpm_b, 6) as cpm_b, round(log2FC, 6) as log2fc, round(u, 6) as u, round(z, 6) as z, round(Mean_CPM, 6) as mean_cpm from dge")
def pairwise_dge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dge.pairwise_dge(fx.counts(spark, sf_dir), fx.labelled(spark, sf_dir), A, B)
    return rounded(rows.select("feature_name", "cpm_a", "cpm_b", F.col("log2FC").alias("log2fc"), "u", "z", F.col("Mean_CPM").alias("mean_cpm")))


@query("select feature_name, round(qval, 6) as qval, is_stat_sig, is_practical_sig from dge")
def dge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir).select("feature_name", "qval", "is_stat_sig", "is_practical_sig"))


@query("select feature_name, case when is_practical_sig and log2FC > 0 then 'A_enriched' when is_practical_sig and log2FC < 0 then 'B_enriched' when is_stat_sig then 'Stat_sig_only' else 'NS' end as category from dge")
def dge_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dge.categorized(compared(spark, sf_dir)).select("feature_name", "category")


@query("""select feature_name, case when m > 25e-2 then 'A_enriched' when m < -25e-2 then 'B_enriched' else 'mixed' end as category from
 (select feature_name, avg(log2FC * s) as m from pair_z, (select unnest([1e0, 5e-1, 0e0]) as s) group by feature_name)""")
def scale_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).select("feature_name", F.explode(F.array(*(F.col("log2FC") * s for s in (1.0, 0.5, 0.0)))).alias("lfc"))
    mean = F.avg("lfc").over(Window.partitionBy("feature_name"))
    return rows.select("feature_name", F.when(mean > 0.25, "A_enriched").when(mean < -0.25, "B_enriched").otherwise("mixed").alias("category")).distinct()


@query("""select feature_name, case when log2FC > 0 then 'A' else 'B' end as direction, round(log2FC, 2) as log2fc, round(Mean_CPM, 2) as mean_cpm from
 (select *, row_number() over (order by log2FC desc, feature_name) as u1, row_number() over (order by log2FC, feature_name) as d1 from dge where is_practical_sig) where u1 <= 20 or d1 <= 20""")
def dge_top_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dge.dge_top_both(compared(spark, sf_dir).filter("is_practical_sig"))
    return rows.select("feature_name", "direction", F.col("log2FC").alias("log2fc"), F.col("Mean_CPM").alias("mean_cpm"))


@query("select feature_name, round(qval, 6) as qval from (select * from dge where qval < 5e-2 and Mean_CPM >= 5 order by qval, abs(log2FC) desc, feature_name limit 60)")
def sig_gene_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dge.sig_gene_rank(compared(spark, sf_dir)).select("feature_name", "qval"))


@query("""select feature_name, min(place) as place from (
 select feature_name, row_number() over (order by log2FC desc, feature_name) as place from dge where is_practical_sig
 union all select gene, 1000000 + row_number() over (order by gene) from marker_groups where grp = 'CORE') where feature_name in (select feature_name from counts) group by feature_name""")
def gene_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = compared(spark, sf_dir).filter("is_practical_sig").select("feature_name", F.row_number().over(Window.orderBy(F.desc("log2FC"), "feature_name")).alias("place"))
    manual = fx.marker_groups(spark, sf_dir).filter("`group` = 'CORE'").select(F.col("gene").alias("feature_name"), F.row_number().over(Window.orderBy("gene")).alias("place"))
    return dge.gene_list_union(first, manual, fx.counts(spark, sf_dir))


_PANEL = """(select x_bin, y_bin, cluster_sorted, feature_name, cast(count as double) / lib * 1e6 as pc from (select *, cast(sum(count) over (partition by x_bin, y_bin) as double) as lib from counts
 where feature_name in (select gene from marker_groups where grp <> 'Brand')) where lib >= 5 and cluster_sorted in (1, 2))"""
_PANEL_DGE = f"""select feature_name, avg(v) filter (cluster_sorted = 1) as cpm_a, avg(v) filter (cluster_sorted = 2) as cpm_b, log2((avg(v) filter (cluster_sorted = 1) + 1) / (avg(v) filter (cluster_sorted = 2) + 1)) as log2fc,
  sum(mid) filter (cluster_sorted = 1) - count(*) filter (cluster_sorted = 1) * (count(*) filter (cluster_sorted = 1) + 1) / 2e0 as u from (
 select *, rank() over (partition by feature_name order by v) + (count(*) over (partition by feature_name, v) - 1) / 2e0 as mid from (
  select g.feature_name, c.cluster_sorted, coalesce(p.pc, 0) as v from (select distinct feature_name from {_PANEL}) g cross join (select distinct x_bin, y_bin, cluster_sorted from {_PANEL}) c
  left join {_PANEL} p on p.feature_name = g.feature_name and p.x_bin = c.x_bin and p.y_bin = c.y_bin)) group by feature_name having cpm_a >= 10 or cpm_b >= 10"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfields.operators import grid

    genes = fx.marker_groups(spark, sf_dir).filter("`group` <> 'Brand'").select(F.col("gene").alias("feature_name"))
    rated = grid.panel_cpm(fx.counts(spark, sf_dir).drop("lib_size", "cpm"), genes)
    return dge.panel_dge(rated, fx.labelled(spark, sf_dir), A, B)


@query(f"select feature_name, round(cpm_a, 6) as cpm_a, round(cpm_b, 6) as cpm_b, round(log2fc, 6) as log2fc, round(u, 6) as u from ({_PANEL_DGE})")
def panel_dge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).select("feature_name", "cpm_a", "cpm_b", F.col("log2FC").alias("log2fc"), "u"))


@query(f"""select side, feature_name, cast(r as integer) as rank from (select *, row_number() over (partition by side order by log2fc desc, feature_name) as r from
 (select *, case when log2fc > 0 then 'A' else 'B' end as side from ({_PANEL_DGE}) where abs(log2fc) > 5e-1)) where r <= 15""")
def panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumn("qval", F.lit(0.0))
    return dge.panel_report(rows).select("side", "feature_name", "rank")


_UP = "select feature_name as gene from dge where is_stat_sig and log2FC > 0"
_HITS = f"""select library, term, coalesce(sum(case when gene in ({{genes}}) then 1 else 0 end), 0) as hits, count(*) as marked, (select count(*) from ({{genes}})) as drawn, (select count(*) from dge) as total
 from (select distinct library, term, gene from gene_sets where gene in (select feature_name from dge)) group by library, term"""
_UP_HITS = _HITS.format(genes=_UP)
_ODDS = "((hits + 5e-1) * (total - marked - drawn + hits + 5e-1)) / ((marked - hits + 5e-1) * (drawn - hits + 5e-1))"


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = checkpoint(compared(spark, sf_dir))
    listed = [rows.filter(F.col("is_stat_sig") & side).select(F.col("feature_name").alias("gene")) for side in (F.col("log2FC") > 0, F.col("log2FC") < 0)]
    return *listed, fx.gene_sets(spark, sf_dir), rows.select(F.col("feature_name").alias("gene"))


@query(f"select library, term, cast(hits as bigint) as hits, marked, drawn, total, cast(hits as bigint) || '/' || marked as overlap, round({_ODDS}, 6) as odds_ratio from ({_UP_HITS}) where hits > 0")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, _, sets, base = _lists(spark, sf_dir)
    return rounded(enrichment.with_odds(enrichment.overlap_counts(up, sets, base).filter("hits > 0")))


_CHANCE = "lgamma(marked + 1e0) - lgamma(k + 1e0) - lgamma(marked - k + 1e0) + lgamma(total - marked + 1e0) - lgamma(drawn - k + 1e0) - lgamma(total - marked - drawn + k + 1e0) - lgamma(total + 1e0) + lgamma(drawn + 1e0) + lgamma(total - drawn + 1e0)"
_TAIL = f"least(list_sum(list_transform(range(cast(greatest(hits, 0, drawn + marked - total) as bigint), cast(least(drawn, marked) + 1 as bigint)), lambda k: exp({_CHANCE}))), 1e0)"


def enrichment_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, _, sets, base = _lists(spark, sf_dir)
    found = enrichment.enrichment(up, sets, base)
    return found.select(*(F.round(c, 9 if c.endswith("val") else 4).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


QUERIES["enrichment"] = enrichment_result  # the name is the module's here
ORACLE_SQL["enrichment"] = fx.BASE_SQL + f"""select library, term, hits, marked, drawn, total, overlap, round(odds_ratio, 4) as odds_ratio, round(pval, 9) as pval, round(qval, 9) as qval, round(-ln(pval + 1e-300) * odds_ratio, 4) as combined_score from (
 select *, least(min(pval * m / r) over (partition by library order by r desc rows between unbounded preceding and current row), 1e0) as qval from (
  select *, row_number() over (partition by library order by pval) as r, count(*) over (partition by library) as m from (
   select library, term, cast(hits as bigint) as hits, marked, drawn, total, cast(hits as bigint) || '/' || marked as overlap, {_ODDS} as odds_ratio, {_TAIL} as pval from ({_UP_HITS}) where hits > 0)))"""


@query(f"select library, term, cast(hits as bigint) as hits, marked, drawn, total, round({_TAIL}, 9) as pval, round(abs(log10({_TAIL})), 6) as nlog10 from ({_HITS.format(genes=_UP.replace('> 0', '< 0'))})")
def hypergeom_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, down, sets, base = _lists(spark, sf_dir)
    rows = enrichment.overlap_counts(down, sets, base).withColumn("pval", scalar.hypergeom_sf("hits", "drawn", "marked", "total"))
    return rows.select("library", "term", "hits", "marked", "drawn", "total", F.round("pval", 9).alias("pval"), F.round(F.abs(F.log10("pval")), 6).alias("nlog10"))


@query(f"select term, min(library) as library from ({_UP_HITS}) group by term")
def dedupe_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, _, sets, base = _lists(spark, sf_dir)
    return enrichment.dedupe_terms(enrichment.overlap_counts(up, sets, base)).select("term", "library")


_SIDE = """select term, '{side}' as side, round(-log10(p + 1e-10), 6) as score_rawp, round({sign} * -log10(p + 1e-10), 6) as plot_score from (
 select *, row_number() over (order by -log10(p + 1e-10) desc, term) as r from (select term, min_by(exp(-{odds}), library) as p from ({hits}) where hits > 0 group by term) where p < 5e-1) where r <= 15"""


@query(" union all ".join("(" + _SIDE.format(side=s, sign=g, odds=_ODDS, hits=_HITS.format(genes=q)) + ")" for s, g, q in (("A", 1, _UP), ("B", -1, _UP.replace("> 0", "< 0")))))
def enrich_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down, sets, base = _lists(spark, sf_dir)
    sides = [enrichment.with_odds(enrichment.overlap_counts(x, sets, base).filter("hits > 0")).withColumn("pval", F.exp(-F.col("odds_ratio"))) for x in (up, down)]
    return rounded(enrichment.enrich_top_terms(*sides, cutoff=0.5))


@query("select cast(1 as bigint) as n, round(ari, 6) as ari from (select (both_ - e) / ((a + b) / 2 - e) as ari from (select both_, a, b, a * b / (t * (t - 1) / 2e0) as e from (select (select sum(n * (n - 1) / 2e0) from (select count(*) as n from labelled group by cluster_sorted, y_bin // 40)) as both_, (select sum(n * (n - 1) / 2e0) from (select count(*) as n from labelled group by cluster_sorted)) as a, (select sum(n * (n - 1) / 2e0) from (select count(*) as n from labelled group by y_bin // 40)) as b, (select count(*) from labelled) as t)))")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.labelled(spark, sf_dir).withColumn("other", F.floor(F.col("y_bin") / 40))
    return rounded(ranks.adjusted_rand(rows, "cluster_sorted", "other").select(F.lit(1).cast("long").alias("n"), "ari"))


@query("select feature_name, round(ln(1 + cpm), 6) as log1p, round(log2(cpm), 6) as log2, round(-log10(cpm + 1e-300), 6) as nlog10, round(-log10(cpm + 1e-10), 6) as nlog10_raw from counts")
def log_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cpm")
    return rounded(fx.counts(spark, sf_dir).select("feature_name", F.log1p(c).alias("log1p"), F.log2(c).alias("log2"), scalar.minus_log10(c).alias("nlog10"), scalar.minus_log10(c, 1e-10).alias("nlog10_raw")))


@query("select x_bin, y_bin, least(greatest(transcript_count, 12), 50) as clipped from cells")
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select(*CELL, scalar.clip_range(F.col("transcript_count"), 12, 50).cast("long").alias("clipped"))


@query("select x_bin, y_bin, round(s, 6) as signed, round(abs(s), 6) as absolute from (select x_bin, y_bin, case when up + low > 0 then (up - low) / cast(up + low as double) else 0 end as s from (select x_bin, y_bin, transcript_count % 7 as up, transcript_count % 5 as low from cells))")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalar.imbalance(F.col("transcript_count") % 7, F.col("transcript_count") % 5)
    return rounded(fx.cells(spark, sf_dir).select(*CELL, s.alias("signed"), F.abs(s).alias("absolute")))


@query(r"""select p_partkey, case when length(t) > 45 then left(t, 42) || '...' else t end as label from (select p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_name || '_' || p_type, '_', ' '), '[\p{L}]+|[^\p{L}]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') as t from part)""")
def clean_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat(F.lit("HALLMARK_"), "p_name", F.lit("_"), "p_type", F.lit(" (GO:0001)"))
    return parts.select("p_partkey", scalar.clean_term(raw).alias("label"))


@query("select x_bin, y_bin, name as base, 30 as sigma_um, v from (select x_bin, y_bin, unnest(['n', 'z']) as name, unnest([cast(transcript_count as double), round(z_mean_um, 6)]) as v from cells)")
def scale_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.cells(spark, sf_dir).select(*CELL, F.col("transcript_count").cast("double").alias("n_s30"), F.round("z_mean_um", 6).alias("z_s30"))
    long = wide.unpivot(list(CELL), ["n_s30", "z_s30"], "name", "v")
    base, sigma = scalar.scale_from_name(F.col("name"))
    return long.select(*CELL, base.alias("base"), sigma.alias("sigma_um"), "v")


@query("select feature_name, case when qval < 1e-300 then '< 1e-300' else printf('%.3e', qval) end as q from dge")
def format_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("feature_name", scalar.format_q(F.col("qval")).alias("q"))


@query(f"select x_bin, y_bin, round(z, 8) as z, round({fx.normal_sql('z')}, 8) as cdf, round({fx.normal_sql('-z')}, 8) as sf from (select x_bin, y_bin, (z_mean_um - 10e0) / 5e0 as z from cells)")
def normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = ((F.col("z_mean_um") - 10.0) / 5.0).alias("z")
    return rounded(fx.cells(spark, sf_dir).select(*CELL, z).withColumn("cdf", scalar.normal_cdf("z")).withColumn("sf", scalar.normal_sf("z")), 8)


@query("select cluster_sorted, feature_name, cast(rank as integer) as rank from (select cluster_sorted, feature_name, row_number() over (partition by cluster_sorted order by n desc, feature_name) as rank from (select cluster_sorted, feature_name, sum(count) as n from counts group by cluster_sorted, feature_name)) where rank <= 5")
def top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fx.counts(spark, sf_dir).groupBy("cluster_sorted", "feature_name").agg(F.sum("count").alias("n"))
    return top_per_group(sums, ["cluster_sorted"], [F.desc("n"), F.col("feature_name")], 5).select("cluster_sorted", "feature_name", "rank")
