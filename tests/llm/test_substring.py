import hashlib
import random
from collections import Counter

import pytest

from pii_spark.llm import substring
from pii_spark.llm.queries import op1_substring


def brute_force(texts, length):
    windows = Counter()
    split = [(key, (text or "").encode().split()) for key, text in texts]
    for _, words in split:
        windows.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - length + 1):
            if windows[tuple(words[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((str(key), len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(words):
    """Copies, near copies, shared passages at all kinds of borders, repeats inside one text, runs of one word."""
    rng = random.Random(5)
    passages = [words(n, 1000 + n) for n in (34, 35, 36, 50, 70, 120)]
    rows, key = [], 0

    def add(text):
        nonlocal key
        rows.append((key, text))
        key += 1

    for i in range(60):
        own = words(rng.randint(0, 300), i)
        for passage in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 10)
            at = rng.randint(0, len(own))
            own[at:at] = passage[cut:] if rng.random() < 0.5 else passage
        add(rng.choice([" ", "\n", "\t "]).join(own))
    base = words(200, 5000)
    for i in range(40):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(200)] = f"new{i}"
        add(" ".join(copy))
    add("same " * 90)
    add("left " * 20 + "right " * 15)
    add("left " * 34)
    add(" ".join(words(40, 77) + ["mid"] + words(40, 77)))
    add(None)
    add("")
    add(" \n ")
    add("nb sp " * 36)
    rows.append((None, "x " + " ".join(words(40, 88))))
    rows.append((9000, " ".join(words(40, 88))))
    rows += [(9001, " ".join(words(50, 99)))] * 2
    return rows


def test_query_equals_brute_force(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, op1_substring(spark, str(tmp_path)).collect()))
    assert got == brute_force(corpus, 35)


@pytest.mark.parametrize(("length", "seed"), [(5, 2), (12, 12), (20, 1)])
def test_other_lengths(spark, make_docs, corpus, length, seed):
    out = substring.remove_repeats(make_docs(corpus), length, seed, single_spaces=True).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out)
    assert got == brute_force(corpus, length)


def test_spans_and_white_space(spark, make_docs, words):
    passage = " ".join(words(40, 3))
    rows = [(1, f"a\n b {passage} c\n\nd"), (2, f"{passage}  tail"), (3, "x \n y"), (4, None)]
    got = {r["doc_id"]: r for r in substring.remove_repeats(make_docs(rows)).collect()}
    assert got[1]["text"] == "a\n b c\n\nd" and [tuple(s) for s in got[1]["spans"]] == [(2, 42)]
    assert got[2]["text"] == "tail" and got[3]["text"] == "x \n y" and got[4]["text"] is None
    assert (got[1]["n_words"], got[1]["n_removed"], got[1]["_key"], got[1]["lang"]) == (44, 40, "x", "en")


def test_empty_table(spark, make_docs):
    assert substring.remove_repeats(make_docs([])).count() == 0
