"""Over-representation of gene lists in gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfields.functions.ranks import bh_fdr
from binfields.functions.scalar import hypergeom_sf, minus_log10
from binfields.operators.potts import top_per_group


def overlap_counts(genes: DataFrame, gene_sets: DataFrame, background: DataFrame) -> DataFrame:
    """library, term, hits, marked (set genes in the background), drawn (listed genes), total (background)."""
    base = background.select("gene").distinct()
    listed = genes.select("gene").distinct().join(base, "gene", "left_semi").withColumn("listed", F.lit(1))
    inside = gene_sets.select("library", "term", "gene").distinct().join(base, "gene", "left_semi").join(listed, "gene", "left")
    counted = inside.groupBy("library", "term").agg(F.coalesce(F.sum("listed"), F.lit(0)).alias("hits"), F.count("*").alias("marked"))
    sizes = listed.agg(F.count("*").alias("drawn")).join(F.broadcast(base.agg(F.count("*").alias("total"))))
    return counted.join(F.broadcast(sizes))


def enrichment(genes: DataFrame, gene_sets: DataFrame, background: DataFrame) -> DataFrame:
    """Terms with a hit: counts, overlap, odds_ratio, pval (hypergeometric tail), qval (per library), combined_score."""
    rows = overlap_counts(genes, gene_sets, background).filter("hits > 0")
    tested = rows.withColumn("pval", hypergeom_sf("hits", "drawn", "marked", "total"))
    return bh_fdr(with_odds(tested), "pval", ["library"]).withColumn("combined_score", -F.log(F.col("pval") + 1e-300) * F.col("odds_ratio"))


def with_odds(rows: DataFrame) -> DataFrame:
    """Adds overlap (hits/marked) and the odds ratio with half a count added to each cell."""
    h = F.col("hits")
    odds = ((h + 0.5) * (F.col("total") - F.col("marked") - F.col("drawn") + h + 0.5)) / ((F.col("marked") - h + 0.5) * (F.col("drawn") - h + 0.5))
    return rows.withColumn("overlap", F.concat_ws("/", h.cast("string"), F.col("marked").cast("string"))).withColumn("odds_ratio", odds)


def dedupe_terms(rows: DataFrame) -> DataFrame:
    """One row for each term over libraries; the first library by name stays."""
    return top_per_group(rows, ["term"], [F.col("library")], 1, "_r").drop("_r")


def enrich_top_terms(up: DataFrame, down: DataFrame, *, p: str = "pval", cutoff: float = 0.05, n: int = 15) -> DataFrame:
    """Per side the n terms of least raw p below the cutoff, with a score that is negative for the second side."""
    sides = []
    for rows, side, sign in ((up, "A", 1), (down, "B", -1)):
        scored = dedupe_terms(rows).filter(F.col(p) < cutoff).withColumn("score_rawp", minus_log10(F.col(p), 1e-10))
        best = scored.orderBy(F.desc("score_rawp"), "term").limit(n)
        sides.append(best.select("term", F.lit(side).alias("side"), "score_rawp", (F.col("score_rawp") * sign).alias("plot_score")))
    return sides[0].unionByName(sides[1])
