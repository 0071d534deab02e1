import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) as documents, with the other columns and one of an internal-looking name."""

    def make(rows, source="s1", lang="en"):
        full = [(i, t, lang, source, None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def words():
    """A function that draws texts from a small vocabulary, the same in every run."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(3000)]

    def draw(n, seed):
        return random.Random(seed).choices(vocabulary, k=n)

    return draw
