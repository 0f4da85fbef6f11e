import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, runs int, n_words string, `_text` double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(7)
    long = words(rng, 20_000)
    base = words(rng, 300)
    texts = [
        (1, base), (1, base), (2, base), (3, base.replace(" ", " x ", 1)), (4, None), (5, ""), (6, "  \n \t\n"), (None, base), (None, None),
        (7, long), (8, long + " tail"), (9, "Ünïcode wörd. " * 40), (10, "one"), (10, "two"), (11, words(rng, 120) + "\n" + words(rng, 60)),
    ]
    return [(i, t, "en", "s", len(t or ""), "k", 1, "n", 0.5) for i, t in texts]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 6)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (4, 7, 9)], "doc_id long, quality int, toxic int")
