import random
import zlib
from array import array
from fractions import Fraction
from hashlib import sha256

import numpy as np

from pii_spark.llm import periods
from pii_spark.llm.queries import op13_periods


def brute_force(words):
    """All runs (start, length, period), period by period."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q):
                root = words[start : start + q]
                if not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    out = [True] * len(words)
    for start, length, period in runs:
        out[start + period : start + length] = [False] * (length - period)
    return " ".join(w for w, k in zip(words, out, strict=True) if k)


def in_tiles(words):
    """The runs that fragments of tiles give when stitched one after the other."""
    ids = periods.word_ids(" ".join(words).encode())
    fragments = []
    for m, low, at, own, blocks in periods.tile_rows(ids):
        fragments += periods.solve(m, low, at, array("i", np.ascontiguousarray(own, np.int32).tobytes()), blocks)
    whole = {}
    for q, a, b in sorted(fragments):
        held = whole.setdefault(q, [])
        if held and a <= held[-1][1]:
            held[-1][1] = max(b, held[-1][1])
        else:
            held.append([a, b])
    runs = [(a, b - a + q, q) for q, spans in whole.items() for a, b in spans if b - a + q >= max(24, 3 * q)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def drawn(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        root = rng.choices(letters, k=rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 70]))
        words += (root * rng.randint(1, 40))[: rng.randint(1, 40) * 8]
        words += rng.choices("abxyz", k=rng.randint(0, 30))
    return words


def test_tiles_find_all_runs():
    rng = random.Random(11)
    for _ in range(250):
        words = drawn(rng)
        assert in_tiles(words) == brute_force(words), words
    for words in (["a"] * 23, ["a"] * 24, ["a"] * 5000, list("abc") * 8, list("abcabcab") * 300, list("ab") * 11 + ["x"] + list("ab") * 12):
        assert in_tiles(words) == brute_force(words)


def test_z_function_equals_its_definition():
    rng = random.Random(2)
    for _ in range(200):
        w = rng.choices((1, 2), k=rng.randint(0, 40))
        z = periods.z_function(array("i", w))
        assert list(z) == [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(len(w))]


def test_texts_columns_and_odd_rows(spark):
    texts = ["a b c\t" * 10 + "end", None, "", " \n ", "x " * 1000, "a b c\t" * 10 + "end", "é ü\n" * 30, "word in one " * 20]
    rows = [(None if i == 3 else 1, t, "z", 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, runs int")
    out = periods.collapse_runs(df)
    assert out.columns == ["doc_id", "_key", "n_words", "runs", "collapsed", "collapsed_sha256"]
    got = sorted(
        (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"] or "", r["collapsed_sha256"]) for r in out.collect()
    )
    want = []
    for t in texts:
        words = (t or "").replace(" ", "~").split()
        words = [w.replace("~", " ") for w in words]
        runs = brute_force(words)
        text = kept(words, runs)
        want.append((len(words), runs, text if runs else "", sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert periods.collapse_runs(df.limit(0)).count() == 0


def test_very_long_texts():
    long = ["a", "b", "c"] * 400_000
    assert in_tiles(long) == [(0, 1_200_000, 3)]
    rng = random.Random(4)
    root = [str(rng.randint(0, 10**6)) for _ in range(60_000)]
    assert in_tiles([*root[:100], "x", *root * 3, "y"]) == [(101, 180_000, 60_000)]
    text = " ".join(long).encode()
    assert periods._kept(text, [(3, 1_200_000)]) == b"a b c"
    assert periods._kept(text, [(5, 7), (6, 1_199_999)]) == b"a b c a b c"


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_over_the_small_tables(spark, tmp_path, make_docs, words):
    rng, texts = random.Random(9), [(0, None), (1, "")]
    for i in range(2, 250):
        own = drawn(rng) if i % 3 == 0 else words(rng.randint(1, 400), i)
        texts.append((i, rng.choice([" ", "\n", " \t"]).join(own)))
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_periods(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        own = planted(i, (text or "").split())
        runs = brute_force(own)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        wanted = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        digest = sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert got[i] == (len(runs), *wanted, digest, sha256(kept(own, runs).encode()).hexdigest())
    assert sum(v[0] > 0 for v in got.values()) > 50
