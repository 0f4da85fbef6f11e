import random

import numpy as np

from binfields.llm.toxicity import BlockMaxIndex, score_toxicity


def test_block_max_search_is_exact():
    rng = random.Random(0)
    idf = np.array([rng.uniform(1, 5) for _ in range(30)])
    vectors = [(i, rng.randint(0, 1), {rng.randrange(30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}) for i in range(700)]
    index = BlockMaxIndex(vectors, idf, block=16)
    dense = np.zeros((index.n, 30))
    counts = {i: c for i, _, c in vectors}
    for row, i in enumerate(index.ids.tolist()):
        t, w = index.weights(counts[i], idf)
        dense[row, t] = w
    for _ in range(60):
        query = {rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        t, w = index.weights(query, idf)
        q = np.zeros(30)
        q[t] = w
        want = dense @ q
        places, cosines = index.nearest(query, 10)
        order = np.lexsort((np.arange(index.n), -np.round(want, 12)))[:10]
        order = order[want[order] > 0]
        assert np.allclose(cosines, want[order]) and places.tolist() == order.tolist()


def corpus(spark, n=600):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zzfool", "zzdolt", "xxbrute" + rng.choice("abc")]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 120 < len(out) < 280
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.evidence for r in rows if r.predicted)
    bounded = score_toxicity(docs, labels, max_examples=40).join(labels, "doc_id").filter("predicted = toxic").count()
    assert bounded >= 560


def test_evidence_equals_brute_force_cosines(spark):
    """Terms, document frequencies, cosines and neighbours recomputed plainly for every document."""
    from collections import Counter
    from math import log, sqrt
    from zlib import crc32

    from binfields.llm.toxicity import bases_of, terms_in

    docs, labels = corpus(spark, 300)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    train = [i for i in texts if crc32(str(i).encode()) % 3 != 1]
    has = {i: terms_in(t) for i, t in texts.items()}
    n = Counter(label[i] for i in train)
    a, b = (Counter(t for i in train if label[i] == k for t in has[i]) for k in (1, 0))

    def ratio(t):
        seen = (a[t] + b[t]) / (n[0] + n[1])
        parts = ((a[t], n[1] * seen), (b[t], n[0] * seen), (n[1] - a[t], n[1] * (1 - seen)), (n[0] - b[t], n[0] * (1 - seen)))
        return 2 * sum(x * log(x / e) for x, e in parts if x > 0)

    terms = {t for t in a if a[t] >= 3 and a[t] / n[1] >= 3 * b[t] / n[0] and ratio(t) > 20}
    frequency = Counter(t for own in has.values() for t in own & terms)

    def vector(text):
        words = Counter(x for w in text.split() for x in bases_of(w))
        raw = {t: (1 + log(1 if b"#" in t else words[t])) * (log((len(texts) + 1) / (frequency[t] + 1)) + 1) for t in terms_in(text) & terms}
        norm = sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    vectors = {i: vector(t) for i, t in texts.items()}
    rows = score_toxicity(docs, labels).collect()
    told = 0
    for r in rows:
        cosines = {str(i): sum(v * vectors[i].get(t, 0) for t, v in vectors[r.doc_id].items()) for i in train}
        best = sorted((c for c in cosines.values() if c > 1e-12), reverse=True)[:15]
        assert np.allclose([e.cosine for e in r.evidence], best)
        assert all(abs(cosines[e.id] - e.cosine) < 1e-9 and label[int(e.id)] == e.label for e in r.evidence)
        told += bool(best)
    assert told > 50
    # a higher vote never gives a lower score, and calibrated scores sum up to the labels they were fitted to
    assert abs(sum(r.score for r in rows if r.doc_id in set(train)) - n[1]) < 0.25 * n[1]


def test_postings_outside_of_open_blocks_are_not_read():
    rng = random.Random(4)
    idf = np.ones(40)
    vectors = [(i, i % 2, {g: 1, **({20 + g: 1} if i % 3 else {})}) for i in range(2000) for g in [rng.randrange(20)]]
    index = BlockMaxIndex(vectors, idf, block=16)
    read = []
    own = index._read
    index._read = lambda terms, weights, blocks, k: (read.append(len(blocks)), own(terms, weights, blocks, k))[1]
    places, cosines = index.nearest({3: 1, 23: 1}, 5)
    assert len(places) == 5 and np.allclose(cosines, 1) and sum(read) < index.blocks / 2


def test_one_example_of_a_repeated_id(spark):
    docs, labels = corpus(spark, 300)
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' tail') as text"))
    scores = [sorted((r.doc_id, r.score) for r in score_toxicity(d, labels).collect()) for d in (twice, twice.repartition(2, "text"))]
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd_docs, no_docs, labels):
    rows = score_toxicity(odd_docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score_toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert score_toxicity(no_docs, labels).count() == 0


def test_texts_without_terms_have_their_nearest_by_all_words(spark):
    """Words, document frequencies, cosines and neighbours recomputed plainly for every document without a term."""
    from collections import Counter
    from math import log, sqrt
    from zlib import crc32

    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    docs = [(i, t + (" zzfool zzdolt zzfool" if i % 5 == 0 else "")) for i, t in docs]
    label = {i: int(i % 5 == 0) for i, _ in docs}
    texts = {i: t.encode() for i, t in docs}
    train = [i for i in texts if crc32(str(i).encode()) % 3 != 1]
    shared = {w for w, n in Counter(w for i in train for w in set(texts[i].split())).items() if n > 1}
    frequency = Counter(w for t in texts.values() for w in set(t.split()) & shared)

    def vector(text):
        raw = {w: (1 + log(n)) * (log((len(texts) + 1) / (frequency[w] + 1)) + 1) for w, n in Counter(text.split()).items() if w in shared}
        norm = sqrt(sum(v * v for v in raw.values()))
        return {w: v / norm for w, v in raw.items()}

    vectors = {i: vector(t) for i, t in texts.items()}
    rows = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(label.items()), "doc_id long, toxic int")).collect()
    plain = [r for r in rows if not r.evidence]
    assert len(rows) == 150 and len(plain) > 90 and all(not r.similar for r in rows if r.evidence)
    for r in plain:
        cosines = {str(i): sum(v * vectors[i].get(w, 0) for w, v in vectors[r.doc_id].items()) for i in train}
        best = sorted((c for c in cosines.values() if c > 1e-12), reverse=True)[:15]
        assert len(r.similar) == len(best) and np.allclose([x["cosine"] for x in r.similar], best)
        assert all(abs(cosines[x["id"]] - x["cosine"]) < 1e-9 and label[int(x["id"])] == x["label"] for x in r.similar)
    assert sum(r.predicted == label[r.doc_id] for r in rows) >= 148


def test_frequent_terms_are_not_read_as_postings_and_company_changes_nothing():
    rng = random.Random(7)
    idf = np.array([rng.uniform(1, 5) for _ in range(300)])
    vectors = [(i, rng.randint(0, 1), {**{t: rng.randint(1, 4) for t in range(12) if rng.random() < 0.5}, **{rng.randrange(12, 300): 1 for _ in range(6)}}) for i in range(900)]
    vectors += [(1000 + i, label, dict(counts)) for i, label, counts in vectors[:100]]  # copies tie
    index = BlockMaxIndex(vectors, idf, block=16)
    uses = sum(len(c) for _, _, c in vectors)
    assert index.panel.shape == (1000, 12) and len(index.postings) == uses - np.count_nonzero(index.panel) < 0.6 * uses
    dense, counts = np.zeros((index.n, 300)), {i: c for i, _, c in vectors}
    for row, i in enumerate(index.ids.tolist()):
        t, w = index.weights(counts[i], idf)
        dense[row, t] = w
    queries = [{rng.choice([rng.randrange(12), rng.randrange(300)]): rng.randint(1, 3) for _ in range(rng.randint(0, 20))} for _ in range(80)] + [{5: 1}, {200: 2}, {}]
    queries += queries[:10]
    rows = [(q, t, n) for q, c in enumerate(queries) for t, n in sorted(c.items())]
    index.cells = 37 * index.n
    of, places, cosines = index.search(*(np.array(c) for c in zip(*rows, strict=True)), len(queries), 10)
    for q, query in enumerate(queries):
        mine = of == q
        alone = index.nearest(query, 10)
        assert places[mine].tolist() == alone[0].tolist() and cosines[mine].tolist() == alone[1].tolist()
        t, w = index.weights(query, idf) if query else ([], [])
        want = dense[:, t] @ w if query else np.zeros(index.n)
        order = np.lexsort((np.arange(index.n), -np.round(want, 12)))[:10]
        assert places[mine].tolist() == order[want[order] > 0].tolist() and np.allclose(cosines[mine], want[places[mine]], rtol=0, atol=1e-12)


def test_slices_are_read_as_single_texts_are():
    from collections import Counter

    from binfields.llm.common import WORD_BYTES
    from binfields.llm.toxicity import Reader, bases_of, repeated, terms_in

    rng = random.Random(5)
    letters = ["a", "b", "A", "é", "日", "0"]
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 30]))) for _ in range(300)]
    pool += ["aaaaaaaa" + "a" * n for n in range(12)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\0", "-", "^"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    texts += [b"", b"   ", b"a", "日".encode() * 9, b"abab" * 5000]
    split = [t.translate(WORD_BYTES).split() for t in texts]
    terms = sorted(t for t in set().union(*map(terms_in, texts)) if rng.random() < 0.5)
    words = sorted(w for w in {w for own in split for w in own} if rng.random() < 0.5)
    assert any(len(w) > 16 for w in words) and any(len(t) == 9 and t.startswith(b"^") for t in terms)
    found = [list(zip(*(c.tolist() for c in rows), strict=True)) for rows in Reader(terms, words).read(texts)]
    term_of, word_of = ({x: k for k, x in enumerate(xs)} for xs in (terms, words))
    want = [], []
    for k, own in enumerate(split):
        bases = Counter(b for w in own for b in bases_of(w))
        uses = {b: n for b, n in bases.items()} | {repeated(b, least): 1 for b, n in bases.items() for least in (2, 3) if n >= least}
        want[0].extend(sorted((k, term_of[t], n) for t, n in uses.items() if t in term_of))
        want[1].extend(sorted((k, word_of[w], n) for w, n in Counter(own).items() if w in word_of))
    assert found == list(want)
    assert [len(c) for rows in Reader([], []).read(texts) for c in rows] == [0] * 6
