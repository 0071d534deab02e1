"""Detector, decoder and alignment cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.operators import decode, detect, mask, prepare


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(e.label, e.text, e.start) for e in detect.detect_rules(df).first().entities]


def test_rules(spark):
    assert found(spark, "😀 mail a.b+c@x-y.co.uk now") == [("EMAIL", "a.b+c@x-y.co.uk", 7)]
    assert found(spark, "card 4111 1111 1111 1111, not 4111 1111 1111 1112") == [("CREDITCARDNUMBER", "4111 1111 1111 1111", 5)]
    assert found(spark, "from 1.2.3.4 not 1.2.3.400") == [("IPV4", "1.2.3.4", 5)]
    assert found(spark, "call +1 (743) 555-3824!") == [("PHONENUMBER", "+1 (743) 555-3824", 5)]
    assert found(spark, "ssn 123-45-6789") == [("SSN", "123-45-6789", 4)]
    assert found(spark, "x123-45-6789") == []
    assert found(spark, "") == [] and found(spark, None) == []
    assert found(spark, "key " + "a" * 40) == [("SECURITYTOKEN", "a" * 40, 4)]


def test_rules_with_words_beside_a_value(spark):
    def all_found(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return [(e.label, e.text, text[e.start:e.end]) for e in detect.detect_rules(df, detect.ALL_RULES).first().entities]

    for text, want in [
        ("😀 Our tax number is 12-1234567, file it", [("TAXNUM", "12-1234567")]), ("badge 12-1234567", [("IDCARDNUM", "12-1234567")]),
        ("Ship it to 12B Oak Ave, 12345 Paris", [("BUILDINGNUM", "12B"), ("STREET", "Oak Ave"), ("ZIP", "12345")]),
        ("aged 42, not 43", [("AGE", "42")]), ("Reset abcdefghij now", []), ("Reset abc1efghij now", [("PASSWORD", "abc1efghij")]),
        ("Log in as user1234x", []), ("Log in as user1234.", [("USERNAME", "user1234")]), ("AKIA" + "A1" * 8, [("SECURITYTOKEN", "AKIA" + "A1" * 8)]),
        ("Dear O'Brien, Acme Pty Ltd wrote", [("SURNAME", "O'Brien"), ("COMPANYNAME", "Acme Pty Ltd")]),
    ]:
        got = all_found(text)
        assert [g[:2] for g in got] == want and all(g[1] == g[2] for g in got), text


def test_account_numbers_with_check_digits(spark):
    rows = [("GB82 WEST 1234 5698 7654 32", True), ("GB83 WEST 1234 5698 7654 32", False), ("DE89370400440532013000", True)]
    df = spark.createDataFrame(rows, "v string, w boolean")
    assert all(r.g == r.w for r in df.selectExpr("w", f"{detect.mod97_sql('v')} AS g").collect())
    text = "pay GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32"
    found_ = detect.detect_rules(spark.createDataFrame([(text,)], "text string"), [detect.CHECKED_IBAN]).first().entities
    assert [e.text for e in found_] == ["GB82 WEST 1234 5698 7654 32"]


def test_table_function_beside_rows(spark):
    detect.register_spans(spark, "spans_of", detect.RULES)
    spark.createDataFrame([(1, "a@b.org and 1.2.3.4"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("span_texts")
    df = spark.sql("SELECT d.id, s.* FROM span_texts d, LATERAL spans_of(d.t) s")
    assert [(r.id, r.value, r.label, r.start) for r in df.collect()] == [(1, "a@b.org", "EMAIL", 0), (1, "1.2.3.4", "IPV4", 12)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert [r.value for r in spark.sql("SELECT value FROM spans_of('x a@b.org')").collect()] == ["a@b.org"]


def test_rules_are_row_local_jvm_expressions(spark):
    df = spark.range(5).selectExpr("id AS doc_id", "concat('a', id, '@x.org') AS text")
    plan = mask.mask_text(detect.detect_rules(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_threshold_range(spark):
    with pytest.raises(ValueError):
        detect.detect_rules(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), threshold=0.99)


def test_dictionary_words(spark):
    docs = spark.createDataFrame([(1, "Élise met José in Paris, Paris!"), (2, "none")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Paris", "CITY"), ("José", "FIRSTNAME"), ("Paris", "CITY")], "value string, label string")
    want = [("José", "FIRSTNAME", 10), ("Paris", "CITY", 18), ("Paris", "CITY", 25)]
    got = detect.detect_dictionary(docs, gaz).collect()
    assert sorted((r.text, r.label, r.start) for r in got) == want


def test_model_hook_reports_errors(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[{"text": t[:1], "label": "X", "start": 0, "end": 1, "confidence": 0.5}] for t in texts]
        return model

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in detect.detect_with_model(df, load).collect()}
    assert rows[1].error is None and len(rows[1].entities) == 1
    assert "RuntimeError" in rows[2].error and rows[2].entities == []


def test_host_matches(spark):
    df = spark.createDataFrame([("API.example.com:443",), ("example.com",), ("badexample.com",), (None,)], "h string")
    assert [r.m for r in df.select(detect.host_matches(F.col("h"), ["example.com"]).alias("m")).collect()] == [True, True, False, False]


@pytest.mark.parametrize("n,starts", [(0, [0]), (512, [0]), (513, [0, 448]), (960, [0, 448]), (961, [0, 448, 896])])
def test_chunk_starts(spark, n, starts):
    assert spark.range(1).select(decode.chunk_starts(F.lit(n)).alias("s")).first().s == starts


def test_chunks_cover_all_tokens(spark):
    text = " ".join(f"w{i}" for i in range(1500))
    df = prepare.tokenize_offsets(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = sorted(decode.chunk_tokens(df).collect(), key=lambda r: r.chunk_ix)
    seen = set()
    for r in rows:
        assert len(r.tokens) <= fv.MAX_TOKENS
        for i, t in enumerate(r.tokens):
            assert r.text[t.start:t.end] == t.text == f"w{r.first_token + i}"
            seen.add(r.first_token + i)
    assert seen == set(range(1500))


ZERO = (np.zeros((3, 3)), np.zeros(3), np.zeros(3))


def test_viterbi_cases():
    all_o = [np.array([[10.0, -10, -10]] * 3)]
    assert decode.viterbi(all_o, *ZERO)[0].tolist() == [0, 0, 0]
    entity = [np.array([[9.0, 0, 0], [0, 9, 0], [0, 0, 9], [9, 0, 0]])]
    assert decode.viterbi(entity, *ZERO)[0].tolist() == [0, 1, 2, 0]
    penalty = np.array([0.0, 0, -100])
    assert decode.viterbi([np.array([[0.0, 1, 5], [5, 0, 0]])], ZERO[0], penalty, ZERO[2])[0][0] != 2
    moves = np.zeros((3, 3))
    moves[1, 2], moves[1, 1] = 20, -20
    assert decode.viterbi([np.array([[0.0, 9, 0], [0, 1, 1]])], moves, ZERO[1], ZERO[2])[0][1] == 2


def test_viterbi_batch_equals_single():
    rng = np.random.default_rng(1)
    tables = (rng.normal(size=(5, 5)), rng.normal(size=5), rng.normal(size=5))
    some = [rng.normal(size=(n, 5)) for n in (1, 7, 3, 0, 12)]
    together = decode.viterbi(some, *tables)
    for s, path in zip(some, together):
        if len(s):
            assert decode.viterbi([s], *tables)[0].tolist() == path.tolist()
            best = max(np.ndindex(*([5] * len(s))), key=lambda p: tables[1][p[0]] + tables[2][p[-1]] + sum(s[i, x] for i, x in enumerate(p)) + sum(tables[0][a, b] for a, b in zip(p, p[1:]))) if len(s) <= 7 and len(s) < 5 else None
            assert best is None or list(best) == path.tolist()


def grouped(spark, text, tags, threshold=0.25, confidences=None):
    df = spark.createDataFrame([(text,)], "text string").withColumn("tokens", prepare.tokens_of(F.col("text")))
    confidences = confidences or [0.9] * len(tags)
    decoded = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(c).alias("confidence")) for t, c in zip(tags, confidences)])
    out = df.select(decode.group_spans(F.col("text"), F.col("tokens"), decoded, threshold).alias("e")).first().e
    return [(e.text, e.label) for e in out]


def test_group_spans(spark):
    assert grouped(spark, "jane . doe @ x", ["B-EMAIL", "O", "I-EMAIL", "O", "I-EMAIL"]) == [("jane . doe @ x", "EMAIL")]
    assert grouped(spark, "a.b", ["B-EMAIL", "B-EMAIL", "B-EMAIL"]) == [("a.b", "EMAIL")]
    assert grouped(spark, "Ann Bob", ["B-FIRSTNAME", "B-FIRSTNAME"]) == [("Ann", "FIRSTNAME"), ("Bob", "FIRSTNAME")]
    assert grouped(spark, "Ann Bob", ["B-FIRSTNAME", "I-SURNAME"]) == [("Ann", "FIRSTNAME")]
    assert grouped(spark, "x Ann", ["O", "I-FIRSTNAME"]) == [("Ann", "FIRSTNAME")]
    assert grouped(spark, "Ann x y Ann", ["B-SURNAME", "O", "O", "I-SURNAME"]) == [("Ann", "SURNAME"), ("Ann", "SURNAME")]
    assert grouped(spark, "Ann", ["B-SURNAME"], confidences=[0.1]) == []
    assert grouped(spark, "so 1988,", ["O", "B-DATEOFBIRTH", "I-DATEOFBIRTH"]) == [("1988", "DATEOFBIRTH")]


# The two texts below and their tokens are the expected results of alignment.
def test_align_golden(spark):
    text = "Email jonathan.reyes@example.com."
    mask_ = [("jonathan.reyes@example.com", "EMAIL", 6, 32)]
    df = spark.createDataFrame([(text, mask_)], "text string, privacy_mask array<struct<value:string,label:string,start:int,end:int>>")
    row = prepare.align_bio(df).first()
    assert row.tags == ["O", "B-EMAIL"] + ["I-EMAIL"] * 6 + ["O"]
    assert [t.text for t in row.tokens][-1] == "."


def test_align_markup_tokens(spark):
    text = "<Email>jankulovska18@aol.com</Email>"
    offsets = [(0, 0), (0, 1), (1, 6), (6, 7), (7, 10), (10, 13), (13, 18), (18, 20), (20, 21), (21, 24), (24, 25), (25, 28), (28, 30), (30, 35), (35, 36), (36, 36)]
    tokens = F.array(*[F.struct(F.lit(text[a:b]).alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in offsets])
    spans = F.array(F.struct(F.lit("jankulovska18@aol.com").alias("value"), F.lit("EMAIL").alias("label"), F.lit(7).alias("start"), F.lit(28).alias("end")))
    tags = spark.range(1).select(prepare.bio_labels(tokens, spans).alias("t")).first().t
    assert tags == ["IGNORE", "O", "O", "O", "B-EMAIL"] + ["I-EMAIL"] * 7 + ["O", "O", "O", "IGNORE"]


def test_best_entity_far_into_a_text(spark):
    """Spans on several pages, and one token that covers two pages."""
    spans_ = [("a", "A", 10, 20), ("b", "B", 1020, 1030), ("c", "C", 5000, 5003), ("d", "D", 1500, 3000)]
    toks = [("t", 0, 12), ("t", 1015, 1029), ("t", 4999, 5001), ("t", 1000, 2600), ("t", 9000, 9001)]
    df = spark.createDataFrame([(toks, spans_)], "tokens array<struct<text:string,start:int,end:int>>, m array<struct<value:string,label:string,start:int,end:int>>")
    best = df.select(prepare.best_entities(F.col("tokens"), F.col("m")).alias("b")).first().b
    assert [b.label if b else None for b in best] == ["A", "B", "C", "D", None]


def test_missing_offsets_fail(spark):
    df = spark.createDataFrame([("x", [("x", "CITY", None, None)])], "text string, privacy_mask array<struct<value:string,label:string,start:int,end:int>>")
    with pytest.raises(Exception, match="without offsets"):
        prepare.align_bio(df).collect()


def test_tokens_of_accented_words(spark):
    df = spark.createDataFrame([("José Müller\u0301, 42 €",)], "text string")
    tokens = df.select(prepare.tokens_of(F.col("text")).alias("t")).first().t
    assert [t.text for t in tokens] == ["José", "Müller\u0301", ",", "42", "€"]
