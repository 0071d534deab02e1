"""Offsets, spans and dummies against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions import offsets, spans
from pii_spark.functions.dummies import generate_dummy

SPANS = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"


def test_matches_count_code_points(spark):
    texts = ["ab 😀 cd é é x", "", "😀😀", "word " * 5000, "a" * 70 + " b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", offsets.find_matches(F.col("t"), r"\w+|[^\w\s]").alias("m")).collect()
    for row in rows:
        if row.t is None:
            continue
        assert [m.text for m in row.m] == [row.t[m.start:m.end] for m in row.m]
        assert [m.text for m in row.m] == re.findall(r"\w+|[^\w\s]", row.t, re.ASCII)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1024, 1025, 40000])
def test_running_totals(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i % 7).alias("v"))
    got = df.select(offsets.running_totals(F.col("v")).alias("r")).first().r
    total, want = 0, []
    for i in range(1, n + 1):
        total += i % 7
        want.append(total)
    assert got == want


def test_find_value_overlaps_and_words(spark):
    rows = [("aaaa", "aa"), ("here her her", "her"), ("x", ""), ("", "x"), ("😀a😀a", "a"), ("Her HER", "her"),
            ("a.b a.b axb", "a.b"), (r"x \E y \E", r"\E")]
    df = spark.createDataFrame(rows, "t string, v string")
    got = df.select(
        "t", "v", offsets.find_value(F.col("t"), F.col("v")).alias("p"),
        F.transform(offsets.find_word(F.col("t"), F.col("v")), lambda m: m["start"]).alias("w"),
    ).collect()
    plain = {(r.t, r.v): r.p for r in got}
    words = {(r.t, r.v): r.w for r in got}
    assert plain["aaaa", "aa"] == [0, 1, 2]
    assert plain["here her her", "her"] == [0, 5, 9]
    assert plain["x", ""] == [] and plain["", "x"] == []
    assert plain["😀a😀a", "a"] == [1, 3]
    assert words["here her her", "her"] == [5, 9]
    assert words["Her HER", "her"] == [0, 4]
    assert words["a.b a.b axb", "a.b"] == [0, 4]


def merged(spark, text, items, policy="confidence"):
    df = spark.createDataFrame([(text, items)], f"t string, s {SPANS}")
    return df.select(spans.merge_spans(F.col("s"), policy).alias("m")).first().m


def test_merge_identical_and_other_label(spark):
    assert [m.confidence for m in merged(spark, "x" * 500, [("a", "FIRSTNAME", 400, 404, 0.9), ("a", "FIRSTNAME", 400, 404, 0.95)])] == [0.95]
    assert [m.label for m in merged(spark, "x" * 30, [("a", "PHONENUMBER", 10, 21, 0.6), ("a", "SSN", 10, 21, 0.95)])] == ["SSN"]


def test_merge_three_chunks(spark):
    text = "John Smith and john@x.org at 94110 ok"
    items = [
        ("John", "FIRSTNAME", 0, 4, 0.9), ("Smith", "SURNAME", 5, 10, 0.85), ("Smith", "SURNAME", 5, 10, 0.88),
        ("john@x.org", "EMAIL", 15, 25, 0.92), ("john@x.org", "EMAIL", 15, 25, 0.91), ("94110", "ZIP", 29, 34, 0.8),
    ]
    out = merged(spark, text, items)
    assert [(m.label, m.confidence) for m in out] == [("FIRSTNAME", 0.9), ("SURNAME", 0.88), ("EMAIL", 0.92), ("ZIP", 0.8)]


def test_merge_extends_equal_labels(spark):
    text = "John Smith Junior"
    out = merged(spark, text, [("John Smith", "SURNAME", 0, 10, 0.8), ("Smith Junior", "SURNAME", 5, 17, 0.6)])
    assert [(m.text, m.start, m.end) for m in out] == [(text, 0, 17)] and abs(out[0].confidence - 0.7) < 1e-9
    longest = merged(spark, text, [("John", "FIRSTNAME", 0, 4, 0.9), ("John Smith", "SURNAME", 0, 10, 0.5)], "longest")
    assert [m.label for m in longest] == ["SURNAME"]
    with pytest.raises(ValueError):
        merged(spark, text, [], "other")


@pytest.mark.parametrize(
    "text,start,end,want",
    [
        ("born 1988, here", 5, 10, "1988"), ("at yahoo.com now", 3, 12, "yahoo.com"), ("a  x  b", 1, 6, "x"),
        ("end.", 0, 4, "end"), ("what?!", 0, 6, "what?"), (" ", 0, 1, ""), (".", 0, 1, ""), ("x.y", 0, 2, "x."),
    ],
)
def test_trim(spark, text, start, end, want):
    df = spark.createDataFrame([(text, start, end)], "t string, s int, e int")
    b = df.select(spans.trim_bounds(F.col("t"), F.col("s"), F.col("e")).alias("b")).first().b
    assert text[b.start:b.end] == want


def test_stray_span_replaces_first_hit(spark):
    items = [("bob", "X", 90, 93, 1.0, "AL")]
    df = spark.createDataFrame([("hi bob bob", items)], "t string, s array<struct<text:string,label:string,start:int,end:int,confidence:double,dummy:string>>")
    assert df.select(spans.replace_spans(F.col("t"), F.col("s")).alias("r")).first().r == "hi AL bob"


words = st.lists(st.sampled_from(["Anna", "lives", "é", "😀", "in", "Rome", "1234", "é"]), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(words, min_size=1, max_size=10))
def test_mask_and_restore_are_inverse(spark, texts):
    rows = []
    for parts in texts:
        text, found = " ".join(parts), []
        for m in re.finditer("Anna|Rome|1234", text):
            found.append((m.group(), {"A": "FIRSTNAME", "R": "CITY", "1": "ZIP"}[m.group()[0]], m.start(), m.end(), 1.0))
        rows.append((text, found))
    df = spark.createDataFrame(rows, f"t string, s {SPANS}").withColumn("s", spans.with_dummies(F.col("s")))
    out = df.select(
        "t", "s", spans.replace_spans(F.col("t"), F.col("s")).alias("m"),
    ).select(
        "*", spans.restore_by_span(F.col("m"), F.col("s")).alias("exact"),
        spans.restore_text(F.col("m"), spans.masked_to_original(F.col("s"))).alias("mapped"),
    ).collect()
    for row in out:
        assert row.exact == row.t and row.mapped == row.t
        for s in row.s:
            assert s.dummy != s.text and s.text not in row.m.split(" ")


FORMATS = {
    "EMAIL": r"[a-z]+\.[a-z]+@(example|test|invalid)\.(com|org|net)",
    "PHONENUMBER": r"\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\(\d{3}\) \d{3}-\d{4}",
    "SSN": r"\d{3}-\d{2}-\d{4}", "CREDITCARDNUMBER": r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", "USERNAME": r"[a-z]+\d{4}",
    "DATEOFBIRTH": r"\d{2}/\d{2}/(19[5-9]|200)\d", "ZIP": r"\d{5}", "BUILDINGNUM": r"\d{1,3}[A-F]?",
    "IDCARDNUM": r"\d{2}-\d{7}", "DRIVERLICENSENUM": r"[A-Z]\d{9}", "TAXNUM": r"\d{2}-\d{7}",
    "URL": r"https://www\.(example|test|invalid|localhost)\.[a-z]+(/[a-z]+)?", "PASSPORTID": r"[A-Z]{2}\d{7}",
    "NATIONALID": r"\d{3}-\d{4}-\d{4}", "LICENSEPLATENUM": r"[A-Z]{3}-\d{4}", "PASSWORD": r"[A-Za-z0-9!@#$%]{12,16}",
    "IBAN": r"[A-Z]{2}\d{2}( \d{4}){4}", "AGE": r"\d{2}", "SECURITYTOKEN": r"[A-Za-z_]+[A-Za-z0-9]{32,40}",
}
POOLS = {"STREET": fv.STREETS, "CITY": fv.CITIES, "FIRSTNAME": fv.FIRST_NAMES, "SURNAME": fv.SURNAMES,
         "STATE": fv.STATES, "COUNTRY": fv.COUNTRIES}


def test_every_label_has_a_generator(spark):
    rows = [(label, f"value {i}") for label in fv.STANDARD_LABELS for i in range(25)]
    df = spark.createDataFrame(rows, "label string, o string")
    got = df.select(
        "label", "o", generate_dummy(F.col("label"), F.col("o")).alias("a"), generate_dummy(F.col("label"), F.col("o")).alias("b"),
        generate_dummy(F.col("label"), F.col("o"), "other").alias("c"),
    ).collect()
    for r in got:
        assert r.a and r.a == r.b
        if r.label in FORMATS:
            assert re.fullmatch(FORMATS[r.label], r.a), (r.label, r.a)
        elif r.label in POOLS:
            assert r.a in POOLS[r.label]
        else:
            assert r.label == "COMPANYNAME" and r.a.split(" ")[0] in fv.COMPANY_PREFIXES
    assert sum(r.a != r.c for r in got) > len(got) * 0.8


def test_dummy_follows_the_original(spark):
    df = spark.createDataFrame(
        [("ZIP", "12345-6789"), ("DATEOFBIRTH", "01-02-1990"), ("NOPE", "x"), ("CITY", "London")], "label string, o string")
    got = [r.d for r in df.select(generate_dummy(F.col("label"), F.col("o")).alias("d")).collect()]
    assert re.fullmatch(r"\d{5}-\d{4}", got[0]) and re.fullmatch(r"\d{2}-\d{2}-\d{4}", got[1])
    assert got[2] == "[REDACTED]" and got[3] in fv.CITIES and got[3] != "London"
