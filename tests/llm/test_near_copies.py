import random

import corpus_pipeline
from binfields.llm.near_copies import near_copies, one_of_each_copy

FOLDER = "/root/testdata/sf0.001"


def brute(texts):
    """For each text, the first place in its component: sets of five-word shingles, Jaccard 0.8 at least."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root(i) != root(j):
                top[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(texts))]


def cases(rng):
    def prose(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    passage = prose(60)  # held by many texts that are not near otherwise
    texts = [None, "", "  ", "one two", "One  two", "one two three"]
    for _ in range(40):
        own = prose(rng.choice([6, 20, 100, 150]))
        if rng.random() < 0.4:
            own = passage + own
        texts.append(" ".join(own))
        for _ in range(rng.choice([0, 1, 3])):
            now = list(own)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):  # one edited word changes five shingles
                now[rng.randrange(len(now))] = prose(1)[0]
            texts.append(" ".join(now))
            if rng.random() < 0.5:
                own = now  # a chain
    texts += [" ".join([*passage, *prose(rng.randint(0, 25))]) for _ in range(30)]  # passage only: links cross sizes
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = cases(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute(texts)))
    assert 20 < len(set(want.values())) < len(texts) - 40
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want


def test_stage_keeps_one_of_each(spark):
    texts = cases(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, FOLDER).collect()} == set(brute(texts))


def test_odd_rows(odd_docs, no_docs):
    kept = one_of_each_copy(odd_docs)
    assert kept.columns == odd_docs.columns and 0 < kept.count() <= 15
    assert near_copies(no_docs).count() == 0 and one_of_each_copy(no_docs).count() == 0
