import math
import random

import numpy as np
from pyspark.sql import functions as F

from binfields.llm.neighbours import BITS, Codes, _Block, nearest_neighbours, part_radii, substrings

SCHEMA = "vec_id long, embedding array<float>, id string, v int, block string, q_ids int"


def brute(rows, k, every):
    width = max([len(v) for _, v in rows if v is not None], default=0)
    fine = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in fine if i % every == 0}:
        best = {}
        for _, a in (r for r in fine if r[0] == q):
            for i, b in fine:
                if i != q:
                    best[i] = min(best.get(i, math.inf), math.dist(a, b))
        for rank, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1):
            out[q, rank] = (i, d)
    return out


def run(spark, rows, k, every, **options):
    df = spark.createDataFrame([(i, v, "x", 1, "b", 2) for i, v in rows], SCHEMA).repartition(3)
    out = nearest_neighbours(df, F.col("vec_id") % every == 0, k=k, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    found = out.collect()
    assert len({(r.query_id, r["rank"]) for r in found}) == len(found)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}


def same(found, wanted):
    assert found.keys() == wanted.keys()
    assert [found[q][0] for q in found] == [wanted[q][0] for q in found]
    assert np.allclose([found[q][1] for q in found], [wanted[q][1] for q in found], rtol=1e-14, atol=0)


def vectors(rng, n, width, begin=0):
    return [(begin + i, [float(np.float32(rng.gauss(0, 1))) for _ in range(width)]) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = vectors(random.Random(1), 1500, 24)
    found, wanted = run(spark, rows, 10, 50, block=400, group=8), brute(rows, 10, 50)
    ids = lambda x, q: {i for (a, _), (i, _) in x.items() if a == q}
    queries = {q for q, _ in wanted}
    assert np.mean([len(ids(found, q) & ids(wanted, q)) / 10 for q in queries]) >= 0.9
    assert all(math.isclose(d, math.dist(rows[q][1], rows[i][1]), rel_tol=1e-14) for (q, _), (i, d) in found.items())


def test_all_codes_in_the_radius_give_the_exact_answer(spark):
    rng = random.Random(2)
    rows = vectors(rng, 200, 9) + [(300 + i, [1.0] * 9) for i in range(150)] + [(50, [1.0] * 9), (7, [0.25] * 9), (7, [0.5] * 9)]
    same(run(spark, rows, 5, 25, radius=BITS, block=64, group=3), brute(rows, 5, 25))


def test_queries_without_enough_in_the_radius_look_farther(spark):
    rows = vectors(random.Random(3), 60, 70)
    same(run(spark, rows, 4, 10, radius=0), brute(rows, 4, 10))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, nan]), (15, [inf, 0.0]), (20, [None, 1.0]), (None, [1.0, 1.0]), (25, [3.0]), (30, [0.0, 0.0]), (35, []), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    same(run(spark, rows, 3, 5), brute(rows, 3, 5))
    same(run(spark, [(5, [1.0])], 3, 5), {})
    same(run(spark, [], 3, 5), {})


def test_probes_find_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((3000, 16))
    codes = Codes(rows)
    made = codes.of(rows)
    for parts in (2, 4, 8):
        orders = np.argsort(substrings(made, parts), axis=1, kind="stable").astype(np.int32)
        block = _Block(np.arange(3000).tobytes(), made.tobytes(), orders.tobytes(), rows.tobytes(), 16, parts)
        for radius in (0, 1, 5, 11, 23):
            allowed = part_radii(radius, parts)
            assert sum(r + 1 for r in allowed) == radius + 1
            for q in range(0, 3000, 500):
                found = block.within(made[q], substrings(made[q : q + 1], parts)[:, 0], radius, allowed)
                assert found.tolist() == np.flatnonzero(np.bitwise_count(made ^ made[q]) <= radius).tolist()
