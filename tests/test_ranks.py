import math
import os
import random

import pytest
from pyspark.sql import functions as F

from binfields.functions import ranks, scalar, summary


def midranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("seed", range(3))
def test_sparse_rank_sums_equal_pair_counting(spark, seed):
    rng = random.Random(seed)
    labels = {c: rng.randint(0, 2) for c in range(40)}
    values = [(g, c, labels[c], float(rng.choice([0, 1, 1, 2, 5]))) for g in "ab" for c in labels]
    df = spark.createDataFrame([v for v in values if v[3]], "feature_name string, cell int, label int, cpm double")
    sizes = spark.createDataFrame([(k, list(labels.values()).count(k)) for k in range(3)], "label int, n_cells long")
    rows = {(r.feature_name, r.label): r for r in ranks.rank_test(ranks.rank_sums(df, sizes, "label")).collect()}
    for g in "ab":
        for k in range(3):
            a = [v[3] for v in values if v[0] == g and v[2] == k]
            b = [v[3] for v in values if v[0] == g and v[2] != k]
            u = sum((x > y) + (x == y) / 2 for x in a for y in b)
            own = rows[g, k]
            assert own.u == pytest.approx(u) and own.n1 == len(a) and own.n2 == len(b)
            assert own.score == pytest.approx((u / len(a) / len(b) - 0.5) * 2) and 0 <= own.pval <= 1


def test_all_equal_values_have_p_one(spark):
    df = spark.createDataFrame([("g", 0, 3.0), ("g", 1, 3.0)], "feature_name string, label int, cpm double")
    sizes = spark.createDataFrame([(0, 1), (1, 1)], "label int, n_cells long")
    assert {r.pval for r in ranks.rank_test(ranks.rank_sums(df, sizes, "label")).collect()} == {1.0}


def test_midrank_and_global_rank(spark):
    values = [3, 1, 1, 2, 3, 3]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(3)
    assert [r.midrank for r in ranks.midrank(df, "v").orderBy("i").collect()] == midranks(values)
    assert [r["rank"] for r in ranks.global_rank(df, ["v", "i"]).orderBy("v", "i").collect()] == [1, 2, 3, 4, 5, 6]


def test_bh(spark):
    p = [0.01, None, 0.04, 0.04, 0.5]
    rows = ranks.bh_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").orderBy("i").collect()
    filled = [1.0 if x is None else x for x in p]
    order = sorted(range(5), key=lambda i: filled[i])
    want, low = [0.0] * 5, 1.0
    for rank in range(5, 0, -1):
        low = min(low, filled[order[rank - 1]] * 5 / rank)
        want[order[rank - 1]] = low
    assert [r.qval for r in rows] == pytest.approx(want)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(k % 3, (k % 3 + 1) % 3, k % 2) for k in range(30)], "a int, b int, c int")
    assert ranks.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1.0)
    assert abs(ranks.adjusted_rand(df, "a", "c").first().ari) < 0.2


def test_spearman_needs_enough_rows(spark):
    df = spark.createDataFrame([(g, float(k), float(k**3)) for g, n in (("x", 25), ("y", 10)) for k in range(n)], "g string, a double, b double")
    rows = {r.g: r.rho for r in ranks.spearman(df, "a", "b", ["g"]).collect()}
    assert rows["x"] == pytest.approx(1.0) and rows["y"] is None


def test_tails(spark):
    row = spark.range(1).select(scalar.normal_cdf(F.lit(1.96)).alias("c"), scalar.normal_sf(F.lit(0.0)).alias("s")).first()
    assert row.c == pytest.approx(0.9750021, abs=1e-6) and row.s == 0.5
    total = sum(math.comb(5, k) * math.comb(15, 4 - k) for k in range(2, 5)) / math.comb(20, 4)
    tail = lambda *x: spark.range(1).select(scalar.hypergeom_sf(*map(F.lit, x)).alias("p")).first().p
    assert tail(2, 4, 5, 20) == pytest.approx(total)
    assert tail(0, 4, 5, 20) == 1.0


def test_effect_size_and_bins(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0), ("B", 9.0), ("C", 0.0)], "s string, v double")
    d = df.agg(summary.cohens_d(F.col("v"), F.col("s") == "A", F.col("s") == "B").alias("d")).first().d
    assert d == pytest.approx((2 - 7) / math.sqrt((2 + 8) / 2))
    assert df.agg(summary.cohens_d(F.col("v"), F.col("s") == "A", F.col("s") == "C").alias("d")).first().d is None
    bins = spark.createDataFrame([(x,) for x in (-400.0, -360.0, 0.0, 400.0, 401.0)], "d double").select(scalar.distance_bin(F.col("d"), -400.0, 400.0, 40.0).alias("b"))
    assert [r.b for r in bins.collect()] == [-380.0, -380.0, -20.0, 380.0, None]


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", 9.0, 2.0)], "k string, v double, w double")
    assert ranks.weighted_quantile(df, "v", "w", ["k"], 0.5, "q").first().q == 2.0


def test_normal_tail_to_twelve_digits(spark):
    points = [k / 37 for k in range(-400, 1400)] + [0.0, -0.0, 0.46875 * math.sqrt(2), 4 * math.sqrt(2), 38.0, 60.0, -60.0, 1e-300]
    rows = spark.createDataFrame([(x,) for x in points] + [(None,), (float("nan"),)], "x double")
    for r in rows.select("x", scalar.normal_sf("x").alias("s"), scalar.normal_cdf("x").alias("c")).collect():
        if r.x is None:
            assert r.s is None and r.c is None
        elif math.isnan(r.x):
            assert math.isnan(r.s)
        else:
            assert r.s == pytest.approx(0.5 * math.erfc(r.x / math.sqrt(2)), rel=1e-12, abs=1e-306)
            assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12, abs=1e-306)


def test_hypergeometric_tail_equals_whole_numbers(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(300):
        total = rng.choice([5, 30, 200, 3000])
        marked, drawn = rng.randint(0, total), rng.randint(0, total)
        cases.append((rng.randint(0, min(marked, drawn) + 1), drawn, marked, total))
    rows = spark.createDataFrame(cases, "hits long, drawn long, marked long, total long")
    for r in rows.withColumn("p", scalar.hypergeom_sf("hits", "drawn", "marked", "total")).collect():
        ways = sum(math.comb(r.marked, k) * math.comb(r.total - r.marked, r.drawn - k) for k in range(max(r.hits, 0), min(r.marked, r.drawn) + 1) if r.drawn - k <= r.total - r.marked)
        want = ways * 10**320 // math.comb(r.total, r.drawn) / 10**320 if ways else 0.0
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_rank_sums_by_range_equal_those_by_window(spark):
    rng = random.Random(4)
    values = [(g, k % 3, float(rng.randint(0, 40))) for g in "abc" for k in range(300)]
    df = spark.createDataFrame(values, "feature_name string, label int, cpm double").filter("cpm > 0")
    sizes = spark.createDataFrame([(k, 100) for k in range(3)], "label int, n_cells long")
    ways = [sorted(map(tuple, ranks.rank_sums(df, sizes, "label", most_in_window=n).collect())) for n in (0, 100_000)]
    assert ways[0] == ways[1]


def test_correlations_of_values_whose_last_bits_change_when_evaluated_again(spark):
    rng = random.Random(12)
    values = [(g, rng.random(), float(rng.randrange(30)), k % 7) for g in "ab" for k in range(100)]
    rows = spark.createDataFrame(values, "g string, x double, y double, c int").repartition(3)
    # as a mean whose parts arrive in another order each time
    unsteady = F.udf(lambda x: x * (1 + os.urandom(1)[0] * 2.0**-50), "double").asNondeterministic()
    for correlation in (lambda r: ranks.partial_spearman(r, "x", "y", "c", ["g"], name="rho"), lambda r: ranks.spearman(r, "x", "y", ["g"])):
        got, want = ({r.g: r for r in correlation(r).collect()} for r in (rows.withColumn("x", unsteady("x")), rows))
        for g in "ab":
            assert got[g].n == want[g].n == 100 and got[g].rho == pytest.approx(want[g].rho, abs=1e-12)
    ranked = ranks.midrank(rows.withColumn("x", unsteady("x")), "x", ["g"])
    assert sorted(r.midrank for r in ranked.collect()) == sorted([*range(1, 101)] * 2)


def test_partial_spearman_equals_residuals_of_midranks(spark):
    rng = random.Random(13)
    x, c = [rng.random() + k / 90 for k in range(90)], [k // 9 for k in range(90)]
    y = [float(rng.randrange(12)) - v for v in c]
    rows = spark.createDataFrame([("g", *v) for v in zip(x, y, c, strict=True)] + [("g", None, 1.0, 1), ("g", 1.0, 1.0, None)], "g string, x double, y double, c int")
    row = ranks.partial_spearman(rows, "x", "y", "c", ["g"]).first()

    def centred(v):
        return [a - sum(v) / len(v) for a in v]

    def dot(v, w):
        return sum(a * b for a, b in zip(v, w, strict=True))

    rx, ry, rc = (centred(midranks(v)) for v in (x, y, c))
    left = [centred(midranks([round(a - dot(r, rc) / dot(rc, rc) * b, 9) for a, b in zip(r, rc, strict=True)])) for r in (rx, ry)]
    assert row.n == 90 and row.partial_rho == pytest.approx(dot(*left) / math.sqrt(dot(left[0], left[0]) * dot(left[1], left[1])))
