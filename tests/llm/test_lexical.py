import math
import random
import re
from collections import Counter

import numpy as np

from binfields.llm import lexical
from tests.llm.conftest import SCHEMA, words

ITEMS = "item_id long, text string, doc_id int, score string, q string"


def terms(text):
    kept = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", kept)


def brute(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    total, n_docs = sum(n for _, _, n in rows), len(rows)
    frequency = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in rows:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, -(2**63) if i is None else i))
        out += [(item, r, None if i == -(2**63) else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def check(spark, docs, items, k=10, parts=3, group_terms=100_000, **sizes):
    table = spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "n", 0.5) for i, t in docs], SCHEMA).repartition(parts)
    asked = spark.createDataFrame([(i, t, 1, "s", "q") for i, t in items], ITEMS)
    found = lexical.search(lexical.build_index(table, **sizes), asked, k=k, group_terms=group_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_many_documents_over_shards_and_blocks(spark):
    """Skewed words: long lists with many blocks, most of which are never unpacked."""
    rng = random.Random(3)
    vocabulary = [words(rng, 1) + str(n) for n in range(400)]
    pick = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, 399)] for _ in range(n))
    docs = [(i, pick(rng.choice([3, 20, 60, 200]))) for i in range(1500)]
    items = [(i, pick(12)) for i in range(12)]
    check(spark, docs, items, shard_docs=400)
    check(spark, docs, items, k=3, parts=1, group_terms=25)


def test_hot_words_copies_and_ties(spark):
    docs = [(i, "same text in all of them") for i in range(400)] + [(1000 - i, "Same TEXT twice text") for i in range(5)] + [(7, "rare same")]
    check(spark, docs, [(1, "same"), (1, "text rare"), (2, "rare rare RARE"), (3, "none such")], k=4, shard_docs=150)


def test_counts_above_a_byte_and_long_gaps(spark):
    docs = [(i, ("word " * (300 if i == 5 else 70_000 if i == 9 else 1)) if i % 300 == 5 or i == 9 else "other") for i in range(700)]
    check(spark, docs, [(1, "word other"), (2, "word")], parts=1)


def test_odd_rows(spark, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows]
    items = [(1, docs[0][1][:80]), (1, docs[0][1][:80]), (None, "one two"), (2, None), (3, ""), (4, "Ünïcode WÖRD 12"), (5, docs[9][1])]
    check(spark, docs, items, shard_bytes=500)


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None), (2, "")], [(1, "a")])


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 900, 300)
    picked = rng.zipf(1.4, lengths.sum()) % 50
    vocabulary = {str(n).encode(): n for n in range(50)}
    made = lexical._shard(list(range(300)), picked, lengths, vocabulary)
    row = {n: v.astype(lexical._STORED[n]).tobytes() if n in lexical._STORED else v for n, v in made.items()}
    shard = lexical._Shard(row, int(lengths.sum()), 300)
    docs = np.repeat(np.arange(300), lengths)
    for word, number in vocabulary.items():
        t = shard.number[word]
        blocks = np.arange(shard.blocks[t], shard.blocks[t + 1])
        own, counts = np.unique(docs[picked == number], return_counts=True)
        place, part = shard.unpack(blocks)
        assert place.tolist() == own.tolist()
        assert part.tolist() == ((1_000_000_000 * counts) // (1000 * counts + shard.norms[own])).tolist()
        best = [part[a : a + lexical.BLOCK].max() for a in range(0, len(part), lexical.BLOCK)]
        assert shard.bounds(t).tolist() == best
