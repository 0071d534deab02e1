import hashlib
import random

import pytest

from pii_spark.llm import bpe
from pii_spark.llm.queries import op5_bpe_round_trip, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [i for some in bpe.load(PATH).encode(text) for i in some]


ODD = ["", " ", "it's THEY'LL  x\n\n y ", "a<|endoftext|> b<|endoftext|>", "é🎉日本   z", "\x1c\x85\x00", "9" * 3000]


def test_ids_equal_the_library(tokenizer):
    for text in [*ODD, "".join(ODD)]:
        assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_code_point(tokenizer):
    for base in range(0, 0x30000, 512):
        chars = [chr(c) for c in range(base, base + 512) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}1 {c}" for c in chars)
        assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_pair_of_latin_characters(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 50)
    signs = [chr(c) for c in range(256)]
    for a in signs:
        text = "".join(f"{a}{b} x{a}{b}'{b}s {a} 7" for b in signs)
        assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids, a


def test_cuts_do_not_cut_pieces(tokenizer, monkeypatch):
    rng = random.Random(4)
    for size in (1, 2, 7):
        monkeypatch.setattr(bpe, "CHARS_AT_ONCE", size)
        for _ in range(60):
            text = "".join(rng.choices(" \n\u2003aé.'s日9", k=60))
            assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_streaming_of_long_runs_equals_one_pass():
    vocabulary = bpe.Bpe(PATH)
    for seed in range(40):
        rng = random.Random(seed)
        alphabet = rng.choice(["ab", "aet", "thein", "-=", "01", "é", "abcdefgh", "ing"])
        data = "".join(rng.choices(alphabet, k=3000)).encode()
        assert list(vocabulary.stream(data, block=rng.choice([1, 7, 300]))) == vocabulary.merge(data)
        assert vocabulary._merge_short(data[:60]) == vocabulary._merge_long(data[:60])


def test_lookahead_is_needed_and_bounded():
    vocabulary = bpe.Bpe(PATH)
    assert max(map(len, vocabulary.token_bytes.values())) < vocabulary.lookahead < 1000
    data = ("abcde" * 400).encode()
    whole = vocabulary.merge(data)
    vocabulary.lookahead = 0
    assert list(vocabulary.stream(data, block=3)) != whole


def test_decoder_keeps_incomplete_characters(tokenizer):
    ids = ids_of("日本🎉é")
    decoder = bpe.Decoder(bpe.load(PATH))
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], last=True) == "日本🎉é"
    assert bpe.Decoder(bpe.load(PATH)).feed(ids[:1], last=True) == tokenizer.decode(ids[:1], skip_special_tokens=False)


def test_operators_and_query(spark, make_docs, tokenizer, words, tmp_path):
    texts = [*enumerate(ODD), (50, None), (None, "x y"), (3, "a"), (3, "a"), (60, " ".join(words(30_000, 1)))]
    docs = make_docs(texts)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [(r["doc_id"], r["text"] or "") for r in back] == [(r["doc_id"], r["decoded"]) for r in back]
    assert back[0]["_key"] == "x"
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, (tuple(r) for r in op5_bpe_round_trip(spark, str(tmp_path)).collect())))
    want = []
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert bpe.digests(docs.limit(0), PATH).count() == 0
