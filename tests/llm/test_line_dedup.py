import random

from binfields.llm.line_dedup import dedup_lines


def brute(rows, least):
    """Removed line places of each row: lines of a run of whole lines with enough words that stands earlier too."""
    lines = {}
    for k, (_, text) in enumerate(rows):
        own = [(n, line.strip(" \t\r\x0b\x0c")) for n, line in enumerate((text or "").split("\n")) if text is not None]
        lines[k] = [(n, x) for n, x in own if x]
    places = []
    for k, own in lines.items():
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b][1].split())
                if words >= least:
                    places.append((tuple(x for _, x in own[a : b + 1]), (rows[k][0], own[a][0]), k, own[a][0], own[b][0]))
                    break
        for b in range(len(own)):
            words = 0
            for a in range(b, -1, -1):
                words += len(own[a][1].split())
                if words >= least:
                    places.append((tuple(x for _, x in own[a : b + 1]), (rows[k][0], own[a][0]), k, own[a][0], own[b][0]))
                    break
    first = {}
    for content, at, *_ in places:
        first[content] = min(first.get(content, at), at)
    out = {k: set() for k in lines}
    for content, at, k, a, b in places:
        if at > first[content]:
            out[k] |= set(range(a, b + 1))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = []
    for i in range(60):
        picked = [rng.choice([*pool, "", "  ", str(rng.random())]) for _ in range(rng.randint(0, 14))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            at = rng.randint(0, len(other))
            picked[1:1] = other[at : at + 5]
        rows.append((i, "\n".join(picked)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (1, 8, 20):
        want = brute(rows, least)
        for r in dedup_lines(docs, min_words=least).collect():
            own = rows[r.doc_id][1].split("\n")
            gone = {n for run in r.removed_runs for n in range(run.begin, run.end + 1)}
            assert gone == want[r.doc_id] and r.n_lines == len(own)
            assert r.text == ("\n".join(x for n, x in enumerate(own) if n not in gone) if gone else rows[r.doc_id][1])


def test_first_copy_and_short_runs_stay(spark):
    long, short = " ".join(["word"] * 60), "a short line"
    docs = spark.createDataFrame([(1, f"{long}\n{short}"), (2, f"{short}\n{long}"), (3, short)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert rows == {1: f"{long}\n{short}", 2: short, 3: short}


def test_frequent_line(spark):
    line = " ".join(["w"] * 60)
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('{line}\\n', id) as text")
    rows = dedup_lines(docs)
    assert rows.filter("size(removed_runs) = 0").count() == 1 and rows.filter("text = cast(doc_id as string)").count() == 2999


def test_odd_rows(odd_docs, no_docs):
    rows = dedup_lines(odd_docs)
    assert rows.count() == 15 and [c for c in odd_docs.columns if c not in rows.columns] == []
    assert rows.filter("text is null").count() == 2
    kept = {r.doc_id: r.text for r in rows.filter("doc_id in (2, 3, 5, 7)").collect()}
    assert kept[2] == "" and kept[3] and kept[5] == "" and kept[7]  # copies of the row with the null id, which comes first
    assert dedup_lines(no_docs).count() == 0
