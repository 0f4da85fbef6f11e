import math
import random

from pyspark.sql import functions as F

from binfields.llm.topk import top_k


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in fine:
        if q % every:
            continue
        best = {}
        for i, b in fine:
            if i != q:
                s = sum(x * y for x, y in zip(a, b, strict=False))
                best[i] = max(best.get(i, -(2**62)), s)
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
            out[q, rank] = (i, -s)
    return out


def check(spark, rows, k=5, every=5, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(4)
    found = top_k(df, F.col("vec_id") % every == 0, k=k, **options).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found} == brute(rows, k, every)


def floats(rng, n=12):
    return [rng.randint(-64, 64) / 64 for _ in range(n)]


def test_random_vectors_with_ties_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, floats(rng)) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300 + i, [0.0] * 12) for i in range(10)]
    check(spark, rows, block=32, depth=3)


def test_three_lists_and_few_candidates(spark):
    rng = random.Random(4)
    check(spark, [(i, floats(rng)) for i in range(60)], lists=3, block=16, depth=2)
    check(spark, [(0, floats(rng)), (5, floats(rng)), (7, floats(rng))])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, nan]), (15, [inf, 0.0]), (20, [None, 1.0]), (None, [1.0, 1.0]), (25, [3.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    check(spark, rows, k=3)
    check(spark, [])
