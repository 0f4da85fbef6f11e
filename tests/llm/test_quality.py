import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from binfields.llm.common import text_view
from binfields.llm.quality import FEATURES, QuadraticDiscriminant, features, keep_good, score_quality


def corpus(spark, n=400):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        text = " ".join(words).capitalize() + "." if good else " ".join(f"{w.upper()}!!" if i % 8 else f"{w}%%%" for w in words)
        docs.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 400 and 40 < len(out) < 120
    assert sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert keep_good(docs, labels).count() == sum(r.predicted for r in rows)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = corpus(spark, 120)
    a, b = ({r.doc_id: r.score for r in score_quality(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_density_difference_against_plain_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)), rng.normal(2, 3, size=(100, 3))]
    n, sums, products = np.array([200, 100]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x])
    model = QuadraticDiscriminant.from_sums(n, sums, products, 0.0)
    model.damping = 1.0
    points = rng.normal(1, 2, size=(20, 3))
    log = []
    for a in x:
        c = np.cov(a.T, bias=True)
        d = points - a.mean(0)
        log.append(-0.5 * (d @ np.linalg.inv(c) * d).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(-(np.log(0.5) + log[1] - log[0])))
    assert np.allclose(model.score(points), want, atol=1e-3)


def test_features_are_finite_for_any_text():
    rows = features(*text_view(pa.array(["", None, "a", "\n\n", "!" * 5000, "ß" * 9])))
    assert rows.shape == (6, len(FEATURES)) and np.isfinite(rows).all() and (rows[0] == rows[1]).all()


def test_odd_rows(odd_docs, no_docs, labels):
    rows = score_quality(odd_docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(no_docs, labels).count() == 0
    assert {r.score for r in score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert keep_good(odd_docs, labels).columns == odd_docs.columns


def plain_features(text):
    """The statistics of one text, character by character."""
    data = (text or "").encode()
    kinds = {"blank": 0, "line": 0, "digit": 0, "upper": 0, "letter": 0, "mark": 0, "loud": 0, "sign": 0}
    for b in data:
        c = chr(b)
        kind = "line" if c == "\n" else "blank" if b < 33 else "digit" if c.isdigit() and b < 128 else "upper" if "A" <= c <= "Z" else "letter" if "a" <= c <= "z" or b >= 128 else "loud" if c == "!" else "mark" if c in ".,;:'\"-()?" else "sign"
        kinds[kind] += 1
    words = data.split()
    some, size, letters = len(words) + 20, len(data) + 120, kinds["upper"] + kinds["letter"] + 100
    different, top = len(set(words)), max(map(words.count, set(words)), default=0)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) if different < 0.9 * len(words) else 0
    stops = data.count(b". ") + data.count(b".\n") + data.endswith(b".") if words else 0
    visible = len(data) - kinds["blank"] - kinds["line"]
    root = math.sqrt
    return [
        math.log1p(len(words)), math.log1p((visible + 100) / some), root(kinds["upper"] / letters), root(kinds["digit"] / size), root(kinds["mark"] / size), root(kinds["loud"] / size),
        root(kinds["sign"] / size), root(kinds["line"] / some), math.log(different + 20) / math.log(some), root(max(top - 1, 0) / some), root(stutter / some), root(stops / some),
    ]


def brute(docs, labels, shrinkage=0.05, damping=0.5):
    """id, held out, score: class densities by determinant and inverse, on the labelled rows outside the fold."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1):
            known[i] = min(y, known.get(i, 1))
    rows = [(i, np.array(plain_features(t))) for i, t in docs]
    own = [np.array([x for i, x in rows if i in known and not out(i) and known[i] == k]) for k in (0, 1)]
    every = np.concatenate(own)
    center, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-8))
    log = []
    for x in own:
        c = np.cov(((x - center) / scale).T, bias=True)
        c = (1 - shrinkage) * c + shrinkage * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
        d = (np.array([r for _, r in rows]) - x.mean(0)) / scale
        log.append(-0.5 * (d @ np.linalg.inv(c) * d).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    odds = math.log(len(own[1]) / len(own[0])) + damping * (log[1] - log[0])
    return [(i, out(i), s) for (i, _), s in zip(rows, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), strict=True)]


def test_query_against_brute_force(spark):
    """The registered query on the smallest tables, all rows."""
    from binfields.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]
    want = {i: (o, s) for i, o, s in brute(docs, labels)}
    rows = QUERIES["op2_quality_classifier"](spark, folder).collect()
    assert len(rows) == len(docs) == len(want)
    for r in rows:
        held, score = want[r.doc_id]
        assert r.held_out == held and abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_statistics_take_few_times_a_batch():
    texts = text_view(pa.array(["Some plain words, and then a stop.\n" * 100] * 1200))
    tracemalloc.start()
    rows = features(*texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 4 * texts[0][-1] and (rows == rows[0]).all()
