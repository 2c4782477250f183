import random

import pytest

from gatewarden.llm.workers import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def sentences():
    """Texts of made-up words, the same on every run."""

    def make(seed, words, letters="abcdefghijklmnop"):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, sentences):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = sentences(1, 30_000)
    shared = sentences(2, 60)
    rows = [
        (1, long_text, "en", "a", 1),
        (2, shared, "en", "a", 1),
        (3, shared, "en", "b", 1),
        (3, shared, "en", "b", 1),
        (4, sentences(3, 40) + " " + shared + "\n\n" + sentences(4, 20), None, "b", None),
        (5, "", "en", None, 0),
        (6, None, None, None, None),
        (None, shared, "en", "a", 5),
        (None, None, None, None, None),
        (7, " \t\n ", "en", "a", 4),
        (8, "Ünïcode ñandú 漢字 \U0001f600   x", "de", "a", 9),
        (9, "one two", "en", "a", 7),
        (10, "x" * 5000 + " " + "ab" * 3000, "en", "a", 11),
        (-11, shared.upper(), "en", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().split()
