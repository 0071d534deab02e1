import random

import pytest

from pii_spark.llm import graph, minhash
from pii_spark.llm.queries import op2_bottom_k


def shingles(text, size):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_force(texts, size, percent=80):
    sets = [(key, shingles(text, size)) for key, text in texts]
    parent = {key: key for key, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, other in sets[:i]:
            common = len(one & other)
            if one and other and 100 * common >= percent * (len(one) + len(other) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((key, len(own), find(key), find(key) == key) for key, own in sets)


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(3)
    texts = []

    def edited(base, n):
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = f"w{rng.random()}"
        return " ".join(copy)

    for i in range(40):
        base = words(rng.choice([1, 2, 3, 5, 9, 40, 60, 200]), i)
        texts += [" ".join(base), " ".join(base).upper() if i % 2 else " ".join(base)]
        texts += [edited(base, rng.randint(0, max(1, len(base) // 8))) for _ in range(6)]
    group = words(150, 999)
    texts += [edited(group, rng.randint(1, 12)) for _ in range(120)]
    line = words(30, 1234)
    texts += [" ".join(line + words(rng.randint(1, 12), 3000 + i)) for i in range(90)]
    texts += ["a b", "a b", "b a", "é É", "É É", None, "", " \t", "one", "One", "x " * 500, "X " * 400]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_query_equals_brute_force(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(op2_bottom_k(spark, str(tmp_path))) == brute_force(corpus, 2)


def test_five_words_and_small_blocks(spark, make_docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "COMPARED", 20)
    assert rows(minhash.near_duplicates(make_docs(corpus))) == brute_force(corpus, 5)


def test_null_ids_repeated_rows_and_empty_table(spark, make_docs):
    docs = make_docs([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (6, None), (9, "z")])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got if r["doc_id"] in (6, 9)) == 2
    assert len({r["component_id"] for r in got if r["doc_id"] in (None, 4)}) == 1
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {6, 9}
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300, 600)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    links += [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
