import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binfields.llm.suffix_dedup import common_prefix, find_anchors, front_code, gram_length, merge_runs, repeated_spans
from binfields.llm.suffix_dedup import _decode as decode


def brute(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = [k for k in range(len(t) + 1) if (gone[k] if k < len(t) else 0) != (gone[k - 1] if k else 0)]
        out.append((list(zip(spans[::2], spans[1::2], strict=True)), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@settings(deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=20), st.binary(max_size=20))
def test_common_prefix(head, a, b):
    a, b = head + a, head + b
    want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert common_prefix(a, b, 0) == want == common_prefix(a, b, min(len(head), want))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=6), unique=True, max_size=8), max_size=6))
def test_merge_of_front_coded_runs(runs):
    coded = [front_code([(s.encode(), b"%d" % k, False) for s in sorted(own)]) for k, own in enumerate(runs)]
    assert [[e[0].decode() for e in decode(c)] for c in coded] == [sorted(own) for own in runs]
    merged = list(merge_runs(coded))
    assert [m[0].decode() for m in merged] == sorted(s for own in runs for s in own)
    for before, now in zip(merged, merged[1:], strict=False):
        assert now[1] == common_prefix(before[0], now[0], 0)


def test_anchors_depend_on_content_only():
    import numpy as np

    rng = random.Random(1)
    window = bytes(rng.randrange(97, 123) for _ in range(200))
    picked = set()
    for pad in (0, 5, 300, 3000):
        text = bytes(rng.randrange(97, 123) for _ in range(pad)) + window
        rows = find_anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200, most=512)[0]
        own = [r for r in rows if r["first"] <= pad <= r["last"]]
        picked.add((int(own[0]["x"]) - pad, int(own[0]["hash"])))
    assert len(picked) == 1 and gram_length(400) == 128


def check(spark, texts, length):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: ([tuple(s) for s in r.spans], r.kept_sha256) for r in repeated_spans(docs, length=length).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    assert rows == dict(enumerate(want))


def test_against_brute_force(spark):
    rng = random.Random(8)

    def prose(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    passages = [prose(n) for n in (25, 30, 31, 45, 90)]
    texts = [None, "", "short", "a" * 100, "ab" * 40]
    for _ in range(60):
        own = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            a = rng.randint(0, 8)
            own = own + passage[a : len(passage) - rng.randint(0, 8)] + prose(rng.randint(0, 20))
        texts.append(own)
    near = prose(200)
    for k in range(8):  # copies that each differ in one place
        at = 20 + 20 * k
        texts.append(near[:at] + "#" + near[at + 1 :])
    texts += [texts[10], texts[10], near]
    check(spark, texts, 30)


def test_hot_text_and_empty_table(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('abcdefghij', 50) || case when id % 2 = 0 then '' else cast(id as string) end as text")
    rows = repeated_spans(docs, length=400)
    assert rows.filter("spans[0][0] = 0 and size(spans) = 1").count() == 2000
    assert repeated_spans(docs.limit(0)).count() == 0


def test_odd_rows(odd_docs):
    rows = repeated_spans(odd_docs).collect()
    assert len(rows) == 15
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter((i, *map(str, w)) for (i, _), w in zip(texts, brute([(t or "").encode() for _, t in texts], 400), strict=True))
    assert Counter((r.doc_id, str([tuple(s) for s in r.spans]), r.kept_sha256) for r in rows) == want


@pytest.mark.parametrize("outer", [1024, 2])
def test_small_ranges_against_brute_force(spark, monkeypatch, outer):
    """Many more ranges than tasks, on one level and on two, and owners told in small pieces."""
    from binfields.llm import suffix_dedup

    divided = []
    plain = suffix_dedup._divided
    monkeypatch.setattr(suffix_dedup, "_divided", lambda *a: divided.append(1) or plain(*a))
    monkeypatch.setattr(suffix_dedup, "OUTER_RANGES", outer)
    monkeypatch.setattr(suffix_dedup, "MOST_PARTITIONS", 8)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SPLITTER_BYTES", 8)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (40, 70)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80))) + rng.choice(passages)[rng.randint(0, 9) :] for _ in range(80)]
    check(spark, texts, 30)
    assert bool(divided) == (outer == 2)


def test_anchors_do_not_depend_on_steps():
    import numpy as np

    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(5000)), np.uint8)
    want = find_anchors(data, np.array([0, len(data)]), 200)[0]
    for most in (1, 64, 512, 777):
        assert find_anchors(data, np.array([0, len(data)]), 200, most=most)[0].tolist() == want.tolist()


def test_texts_of_several_steps_against_brute_force(spark):
    rng = random.Random(4)
    length, step = 30, 1 << 19
    gram = gram_length(length)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=step + 4000))
    seam = text[step - 2 * length : step + 2 * length]
    copies = [seam[k : k + gram] for k in range(len(seam) - gram)]  # each gram stands in a second place, no window of 30 does
    texts = [text, *("#" * 5 + c + "%" * 40 for c in copies)]
    check(spark, texts, length)
