from hypothesis import given, settings
from hypothesis import strategies as st

from binfields.llm.license_scan import TEMPLATES, Scanner, increasing, patience, scan_licenses, words_of

scanner = Scanner(TEMPLATES, 0.8, 4)


def longest(places):
    best = []
    for k, x in enumerate(places):
        best.append(1 + max((best[j] for j in range(k) if places[j] < x), default=0))
    return max(best, default=0)


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), unique=True, max_size=30))
def test_increasing_is_longest(places):
    chosen = [places[k] for k in increasing(places)]
    assert chosen == sorted(chosen) and len(chosen) == longest(places)


@settings(deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=20))
def test_patience_aligns_equal_words_in_order(a, b):
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


def found(text):
    return {f[0] for f in scanner.scan(text.encode())[1]}


def test_every_template_is_found_in_prose():
    for name, text in TEMPLATES:
        assert name in found("Some words before. " * 50 + text + " and some words after it" * 50)


def test_changed_repeated_and_missing_notices():
    notice = "This work is licensed under the GNU General Public License, version 3."
    assert found(notice.replace("work", "little work")) == {"GPL-3.0"}
    finds = scanner.scan((notice + " ").encode() * 3)[1]
    assert [f[1:3] for f in finds if f[0] == "GPL-3.0"] == [(0, 12), (12, 24), (24, 36)]
    assert found("the license of the public is general and this work is under version control") == set()
    assert scanner.scan(b"") == (0, [])


def test_copies_in_every_order():
    """Intact copies and one that lacks a word (any of the notice's): each is found, wherever it stands."""
    for name, text in (TEMPLATES[0], max(TEMPLATES, key=lambda t: len(t[1]))):
        own = [w.decode() for w in words_of(text.encode())]
        least = -(-8 * len(own) // 10)
        for missing in range(len(own)):
            edited = [*own[:missing], "zebra", *own[missing + 1 :]]
            if len(own) - 1 < least:
                continue
            for copies in ([edited, own, own], [own, edited, own], [own, own, edited], [edited, own], [own, edited]):
                for gap in ([], ["filler"] * 3):
                    words = [w for c in copies for w in (*c, *gap)]
                    spans = sorted(f[1:3] for f in scanner.scan(" ".join(words).encode())[1] if f[0] == name)
                    want = [(k * (len(own) + len(gap)), k * (len(own) + len(gap)) + len(own)) for k in range(len(copies))]
                    hit = [any(max(a, x) < min(b, y) and min(b, y) - max(a, x) >= least for x, y in spans) for a, b in want]
                    assert all(hit), (name, missing, spans, want)


def test_planted_notices_against_plain_search(spark):
    """Of random files with planted notices the scan tells every planted one, and nothing where no notice stands."""
    import random

    rng = random.Random(3)
    docs, want = [], {}
    for i in range(60):
        words, planted = [], set()
        for _ in range(rng.randint(0, 4)):
            words += [f"filler{rng.randrange(500)}" for _ in range(rng.randint(0, 30))]
            name, text = rng.choice(TEMPLATES)
            own = [w.decode() for w in words_of(text.encode())]
            if len(own) >= 10 and rng.random() < 0.5:
                own[rng.randrange(len(own))] = "edited"
            planted.add((name, len(words), len(words) + len(own)))
            words += own
        docs.append((i, " ".join(words)))
        want[i] = planted
    for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        finds = [(f.license, f.begin, f.end) for f in r.finds]
        for name, a, b in want[r.doc_id]:
            assert any(n == name and min(b, y) - max(a, x) >= 0.8 * (b - a) - 1 for n, x, y in finds), (r.doc_id, name, a, b, finds)
        for n, x, y in finds:
            assert any(max(a, x) < min(b, y) for _, a, b in want[r.doc_id]), (n, x, y)


def test_places_are_words_of_the_text():
    text = "alpha beta Released under the MIT License. gamma"
    _, begin, end, coverage = scanner.scan(text.encode())[1][0]
    assert words_of(text.encode())[begin:end] == b"released under the mit license".split() and coverage == 1.0


def test_odd_rows(odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == 15 and all(not r.finds for r in rows)
    assert scan_licenses(no_docs).count() == 0
