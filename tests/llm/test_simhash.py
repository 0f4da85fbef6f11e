import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from binfields.llm.components import components
from binfields.llm.simhash import find_components, fingerprint, near_duplicates, one_of_each


def plain(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, tau=4):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= tau and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def signed(v):
    return int(np.uint64(v).astype(np.int64))


def test_fingerprint_equals_plain_form():
    rng = random.Random(0)
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(["a", "B", "cé", "d\t", "e"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain(text)


def test_links_equal_brute_force_for_every_number_of_parts(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(60):  # clusters, chains and strangers
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.choice([0, 1, 8])):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    own = [signed(v) for v in values]
    want = reachable(own)
    nodes = spark.createDataFrame([(v,) for v in own], "fingerprint long")
    for parts in (2, 4):
        rows = find_components(nodes, parts=parts).collect()
        assert {r.fingerprint: r.component for r in rows} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_documents(spark, odd_docs, odd_rows, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 15
    want = reachable([signed(plain(r[1] or "")) for r in odd_rows])
    ids = {}
    for r in odd_rows:
        if r[0] is not None:
            c = want[signed(plain(r[1] or ""))]
            ids[c] = min(ids.get(c, r[0]), r[0])
    for r in rows:
        assert r.component == want[r.fingerprint] and r.component_id == ids.get(r.component)
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(want.values()))
    assert near_duplicates(no_docs).count() == 0 and one_of_each(no_docs).count() == 0


def test_hot_group(spark):
    text = " ".join(str(k) for k in range(50))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    assert near_duplicates(docs).groupBy("component_id").count().collect() == [(0, 3000)]


def test_leaders_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 7, "x", 0, "k", 1), (1, "f g h i j", 8, "y", 1, "k", 2), (2, "a b c d e", 9, "z", 2, "k", 3), (None, "q r s t u", 3, "w", 3, "k", 4)]
    names = "doc_id long, text string, _id long, id string, own int, key string, component long"
    docs = spark.createDataFrame(rows, names)
    kept = one_of_each(docs).collect()
    assert kept and all(r.asDict() in [dict(zip(docs.columns, x, strict=True)) for x in rows] for r in kept)
    assert sorted((r["id"] for r in kept)) == ["w", "x", "y"]
