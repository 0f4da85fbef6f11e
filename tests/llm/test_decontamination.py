import random

from binfields.llm.decontamination import ItemIndex, find_contamination, words_of


def brute(text, items, window=13):
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for name, own in items:
        own = words_of((own or "").encode())
        size = min(window, len(own))
        if not own:
            continue
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(name)
    return len(words), len(hit), sorted(found)


def cases(rng):
    def prose(n):
        return [rng.choice(["a", "b", "the", "x1", "Wort", "é"]) for _ in range(n)]

    items = [(str(k), " ".join(prose(rng.choice([3, 12, 13, 14, 30])))) for k in range(8)] + [("8", ""), ("9", "...")]
    docs = []
    for _ in range(40):
        words = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            own = items[rng.randrange(8)][1].split()
            cut = own[rng.randint(0, 3) :]
            at = rng.randint(0, len(words))
            words[at:at] = cut
        docs.append(", ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return docs, items


def test_index_equals_brute_force_on_few_words():
    for seed in range(15):
        docs, items = cases(random.Random(seed))
        index = ItemIndex([(k, t.encode()) for k, t in items], 13, {b"the": 5, b"a": 3})
        for text in docs:
            words = words_of(text.encode())
            spans, found = index.match(words)
            assert (len(words), sum(b - a for a, b in spans), sorted(index.texts[k][0] for k in found)) == brute(text, items)


def test_both_ways_on_spark(spark):
    texts, items = cases(random.Random(99))
    texts += [None, "", texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), t) for k, t in items] + [(None, "a b"), (77, None)], "item_id long, text string")
    for bound in (10_000, 1):
        rows = find_contamination(docs, bench, max_local_words=bound).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == {i: brute(t, items) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = find_contamination(odd_docs, bench, keep_columns=("n_chars",)).collect()
    assert len(rows) == 15 and all(r.n_hit == 0 for r in rows)
    assert find_contamination(no_docs, bench).count() == 0
    assert find_contamination(odd_docs, bench.limit(0)).count() == 15


def test_one_id_with_several_texts_both_ways(spark):
    rng = random.Random(12)
    items = [("1", " ".join(f"{name}{rng.randrange(10**6)}" for _ in range(20))) for name in "abcd"]
    texts = [f"so {own} it is" for _, own in items] + ["nothing of these"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, own) for _, own in items], "item_id long, text string")
    for bound in (10_000, 0):
        rows = find_contamination(docs, bench, max_local_words=bound).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == {i: brute(t, items) for i, t in enumerate(texts)}


def test_bounds_count_words_as_they_are_compared(spark, monkeypatch):
    """Upper-case words are words; either bound sends a benchmark to the join."""
    from binfields.llm import decontamination

    ways = []
    plain = decontamination._by_join
    monkeypatch.setattr(decontamination, "_by_join", lambda *a: ways.append("join") or plain(*a))
    loud = " ".join(f"WORD{n}" for n in range(2000))
    docs = spark.createDataFrame([(1, "x " + loud.lower() + " y"), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, loud)], "item_id long, text string")
    for bounds, way in (({"max_local_words": 1999}, ["join"]), ({"max_local_words": 2000}, []), ({"max_local_bytes": 15_000}, ["join"])):
        ways.clear()
        rows = find_contamination(docs, bench, **bounds).collect()
        assert ways == way and {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == {1: (2002, 2000, ["5"]), 2: (1, 0, [])}


def test_hot_tokens_and_many_candidates_by_join(spark, monkeypatch):
    from binfields.llm import decontamination

    monkeypatch.setattr(decontamination, "HOT_ONE_IN", 20)
    monkeypatch.setattr(decontamination, "_CANDIDATES", 3)
    rng = random.Random(5)
    items = [(str(k), " ".join(rng.choice("abcde") for _ in range(rng.randint(2, 20)))) for k in range(30)]
    texts = [" ".join(rng.choice("abcde") for _ in range(200)) for _ in range(20)] + ["a " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), t) for k, t in items], "item_id long, text string")
    rows = find_contamination(docs, bench, max_local_words=0).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == {i: brute(t, items) for i, t in enumerate(texts)}
