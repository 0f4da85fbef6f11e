"""Ranks and quantiles beyond what a range shuffle samples, on wide rows and many partitions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from binfields.functions import ranks, scalar, summary


def test_global_rank_equals_row_number_on_many_rows(spark):
    wide = [F.concat(F.lit(f"c{k}-"), F.col("id")).alias(f"c{k}") for k in range(6)]
    rows = spark.range(0, 400_000, 1, 16).select("id", (F.xxhash64("id") % 100_000).alias("v"), *wide)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ranked = ranks.global_rank(rows, ["v", "id"])
        assert ranked.columns == [*rows.columns, "rank"]
        want = rows.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("want"))
        row = ranked.join(want, "id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == F.col("want")).alias("same")).first()
        assert row.n == row.same == 400_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_grouped_ranks_and_quantiles_equal_windows(spark):
    rng = random.Random(6)
    values = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(500)), rng.random()])) for _ in range(30_000)]
    rows = spark.createDataFrame(values, "g string, v double").repartition(7)
    got = ranks.midrank(rows.filter("g is not null"), "v", ["g"])
    own = Window.partitionBy("g").orderBy("v")
    want = rows.filter("g is not null and v is not null").withColumn("w", F.rank().over(own) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2)
    both = got.filter("v is not null").groupBy("g", "v").agg(F.max("midrank").alias("m")).join(want.groupBy("g", "v").agg(F.max("w").alias("w")), ["g", "v"])
    assert both.filter("m <> w").count() == 0 and both.count() > 7_000
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: r for r in ranks.order_statistics(rows, "v", qs, ["g"]).collect()}
    for r in rows.groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(f"q{k}") for k, q in enumerate(qs))).collect():
        assert all(abs(found[r.g][f"q{k}"] - r[f"q{k}"]) < 1e-9 for k in range(5)), r
    assert summary.global_quantile(rows.limit(0), "v", 0.5).first()["quantile"] is None


def test_clean_term(spark):
    terms = {"HALLMARK_TNFA_SIGNALING": "Tnfa Signaling", "x HALLMARK_a-b (GO:12)": "X A-B", "Cell Homo sapiens hsa04110": "Cell", " p53abc": " P53Abc", "Cell Homo sapiens  hsa": "Cell Homo Sapiens  Hsa", "a" * 50: "A" + "a" * 41 + "..."}
    rows = spark.createDataFrame([(k,) for k in terms], "t string").select("t", scalar.clean_term(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == terms
