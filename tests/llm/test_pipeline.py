"""The pipeline against a chain of brute-force versions of its stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pii_spark.llm.queries import tokenizer_path

SYLLABLES = {
    "de": ["schein", "keit", "und", "über", "gesch", "pferd", "ung", "mit", "bach"],
    "en": ["thing", "ing", "the", "wh", "ough", "with", "ness", "tion", "shall"],
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)

    def words(lang, n):
        return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]

    passage = words("en", 60)
    texts = []
    for i in range(140):
        lang = "de" if i % 3 == 0 else "en"
        own = [" ".join(words(lang, rng.randint(5, 30))) for _ in range(rng.randint(2, 8))]
        if i % 4 == 0:
            own.insert(rng.randint(0, len(own)), " menu home about ")
        if i % 9 == 1:
            own.insert(1, " ".join(passage))
        texts.append(("\n".join(own), lang))
    for i in range(30):
        base, lang = texts[i % 3]
        copy = base.split(" ")
        if i % 2:
            copy[rng.randrange(len(copy))] = "changed"
        texts.append((" ".join(copy), lang))
    texts += [(None, "en"), ("", "en"), ("12 34 %%", "de"), ("the shall " * 3000, "en"), (" ".join(passage), "en")]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j][0], texts[j][1] if j % 13 else None, f"s{j % 11}", None if texts[j][0] is None else len(texts[j][0]))
            for i, j in enumerate(order)]


def language(docs):
    return {k: v for k, v in docs.items() if v[0] and re.search(r"[^\W\d_]", v[0])}


def boilerplate(docs, sites=8):
    seen = defaultdict(set)
    for text, source in docs.values():
        for line in text.split("\n"):
            if line.strip(" "):
                seen[line.strip(" ")].add(source)
    out = {}
    for key, (text, source) in docs.items():
        lines = text.split("\n")
        hit = [len(seen[x.strip(" ")]) >= sites for x in lines]
        n = sum(bool(x.strip(" ")) for x in lines)
        goes = 0 < sum(hit) <= n * 0.5
        out[key] = ("\n".join(x for x, h in zip(lines, hit, strict=True) if not h) if goes else text, source)
    return out


def near_duplicates(docs):
    sets = {}
    for key, (text, _) in docs.items():
        words = text.encode().lower().split()
        n = min(5, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    parent = {key: key for key in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {key: value for key, value in docs.items() if find(key) == key}


def repeats(docs, length=50):
    windows, split = Counter(), {}
    for key, (text, _) in docs.items():
        split[key] = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text.encode())]
        words = [text.encode()[a:b] for a, b in split[key]]
        windows.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    out = {}
    for key, (text, source) in docs.items():
        data = text.encode()
        words = [data[a:b] for a, b in split[key]]
        gone = {j for i in range(len(words) - length + 1) if windows[tuple(words[i : i + length])] > 1 for j in range(i, i + length)}
        if len(gone) == len(words) and words:
            continue
        parts, run = [], []
        for i in range(len(words) + 1):
            if i < len(words) and i not in gone:
                run.append(i)
            elif run:
                a = 0 if run[0] == 0 else split[key][run[0]][0]
                b = len(data) if run[-1] == len(words) - 1 else split[key][run[-1]][1]
                parts.append(data[a:b])
                run = []
        out[key] = (b" ".join(parts).decode() if gone else text, source)
    return out


def test_run_equals_the_chain(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = {key: (text, source) for key, text, _, source, _ in rows}
    sizes = [len(docs)]
    for stage in (language, boilerplate, near_duplicates, repeats):
        before, docs = docs, stage(docs)
        sizes.append(len(docs))
        assert docs != before, stage
    tokenizer, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), []
    for key, (text, _) in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want.append((key, at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096


def test_stages_pass_documents_on(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0 and empty.dtypes == docs.dtypes, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
