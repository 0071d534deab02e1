import zlib

import numpy as np
import pytest

from pii_spark.llm import packing
from pii_spark.llm.queries import op10_best_fit, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = [
    "", " ", "Don't STOP'S İstanbul ΑΣ ΣΑΣ.", "á éx ́y", "x y z\x1cw\x85v",
    "<|endoftext|> and<|startoftext|>mid", "日本語 ﬁ Å", "12345 6 🎉🎉", "\x00\x0b\x0c\r\n\t", "a" * 5000,
    "Word. WORD, word., don't. ǅ. É, 1. a1, <|STARTOFTEXT|>. <|endoftext|>, ª. ʰ, Σ. ΑΣ, İ. \u0958. \u0958\u0958, ﬁ. \u1e9b\u0323. 각.",
]


def test_ids_equal_the_library(tokenizer):
    encoder = packing.WordEncoder(PATH)
    for text in [*ODD, " ".join(ODD)]:
        ids = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_letter_before_a_full_stop(tokenizer):
    encoder = packing.WordEncoder(PATH)
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    text = " ".join(f"{c}. x{c}, A{c}" for c in letters)
    ids = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_byte_pair_of_simple_texts(tokenizer):
    encoder = packing.WordEncoder(PATH)
    signs = [chr(c) for c in (*range(1, 127), *range(0xC0, 0x100))]
    texts = ["".join(f"{a}{b} q{a}{b}7{a}'{b}re" for b in signs) for a in signs]
    texts += ["it's 'tis x.'s '' 'LL 're've 'Don'T", "É÷× ÀÉ's"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:3]


def test_best_fit_against_a_list_of_bins():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 101, 2000)]
    for limit in (1, 3, 50, 5000):
        open_bins, want, n = [], [], 0
        for length in lengths:
            fitting = [b for b in open_bins if b[0] >= length]
            if fitting:
                least = min(b[0] for b in fitting)
                chosen = [b for b in fitting if b[0] == least][-1]
                open_bins.remove(chosen)
            else:
                if len(open_bins) >= limit:
                    least = min(b[0] for b in open_bins)
                    open_bins.remove([b for b in open_bins if b[0] == least][-1])
                chosen, n = [100, n], n + 1
            want.append((chosen[1], 100 - chosen[0]))
            chosen[0] -= length
            if chosen[0]:
                open_bins.append(chosen)
        assert list(zip(*packing.best_fit(lengths, 100, limit), strict=True)) == want


def test_pieces_and_sequences(spark, make_docs, tokenizer, words):
    texts = [(i, " ".join(words(i * 37 % 400, i))) for i in range(60)] + [(None, "a b"), (7, None), (7, "a b"), (7, "a b")]
    pieces = packing.token_pieces(make_docs(texts), PATH, capacity=256, keep_ids=True)
    packed = packing.pack(pieces, capacity=256, rows_per_stream=40)
    rows = packed.collect()
    want = []
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want.append((str(key), at // 256, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in sequences.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 256) + 8
    joined = {r["sequence_id"]: r["ids"] for r in packing.packed_ids(packed).collect()}
    assert joined == {k: [i for p in sorted(v) for i in p[2]] for k, v in sequences.items()}


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert op10_best_fit(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 50 - i, 100 + i, 7) for i in range(50)], "doc_id long, _row long, length long, offset long")
    out = packing.pack(df)
    assert out.columns == ["doc_id", "_row", "length", "sequence_id", "offset"]
    assert sorted((r["doc_id"], r["_row"], r["length"]) for r in out.collect()) == [
        (i, None if i == 3 else 50 - i, 100 + i) for i in range(50)
    ]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
