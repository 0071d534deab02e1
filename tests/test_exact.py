"""Exact restoring through the map alone."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.spans import restore_text
from pii_spark.operators import detect, mask

SPANS = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"


def exact(spark, rows):
    df = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], f"id int, text string, entities {SPANS}, _m string")
    out = mask.mask_exact(df.drop("_m"))
    back = restore_text(F.col("masked_text"), F.col("masked_to_original"))
    return sorted(out.withColumn("back", back).collect(), key=lambda r: r.id)


def spanned(text, found):
    spans = [(v, label, m.start(), m.end(), 0.9) for v, label in found for m in re.finditer(re.escape(v), text)]
    return text, sorted(spans, key=lambda s: s[2])


def test_placeholders_and_shared_draws(spark):
    cities = fv.CITIES[:50]
    rows = [
        spanned("a 10.0.0.1 b 10.0.0.2 c [REDACTED] 10.0.0.1", [("10.0.0.1", "IPV4"), ("10.0.0.2", "IPV4")]),
        (" ".join(cities), [(c, "CITY", (" ".join(cities) + " ").index(c + " "), (" ".join(cities) + " ").index(c + " ") + len(c), 0.9) for c in cities]),
        spanned("[[IPV4-1]] and [IPV4-1] at 1.1.1.1", [("1.1.1.1", "IPV4")]),
        ("nothing", []), (None, None), ("", []),
    ]
    got = exact(spark, rows)
    for row, (text, spans) in zip(got, rows, strict=True):
        assert row.back == text or not spans
    assert got[0].masked_text == "a [[IPV4-1]] b [[IPV4-2]] c [REDACTED] [[IPV4-1]]"
    assert got[2].masked_text == "[[IPV4-1]] and [IPV4-1] at [[[IPV4-1]]]"
    assert len(got[1].masked_to_original) == 50
    assert got[3].masked_text == "nothing" and got[3].masked_to_original == {}


def test_rows_without_a_clash_keep_their_dummies(spark):
    df = spark.createDataFrame([(1, "mail ann@corp.org or call 743-555-3824 now")], "doc_id long, text string")
    found = detect.detect_rules(df)
    a, b = mask.mask_text(found).first(), mask.mask_exact(found).first()
    assert a.masked_text == b.masked_text and a.masked_to_original == b.masked_to_original and a.entities == b.entities


def test_dummies_between_a_dummy_and_the_text(spark):
    """Ages one beside the other: two-digit dummies arise all over the row."""
    rng = random.Random(5)
    rows = []
    for _ in range(30):
        text = "".join(rng.choices("0123456789", k=60))
        rows.append((text, [(text[i:i + 2], "AGE", i, i + 2, 0.9) for i in range(0, 60, 3)]))
    for row in exact(spark, rows):
        assert row.back == row.text


parts = st.lists(st.sampled_from(["John", "Jane", "é", "[", "]]", "12", "3", "[AGE-1]", "Oslo", "Rome", " "]), max_size=25)


@settings(max_examples=6, deadline=None)
@given(st.lists(parts, min_size=1, max_size=12))
def test_any_text_comes_back(spark, texts):
    labels = {"John": "FIRSTNAME", "Jane": "FIRSTNAME", "12": "AGE", "3": "IPV4", "Oslo": "CITY", "Rome": "CITY", "[AGE-1]": "X"}
    rows = []
    for t in texts:
        spans, at = [], 0
        for p in t:
            if p in labels:
                spans.append((p, labels[p], at, at + len(p), 0.9))
            at += len(p)
        rows.append(("".join(t), spans))
    for row in exact(spark, rows):
        assert row.back == row.text
        assert len(set(row.masked_to_original.values())) <= len(row.masked_to_original)
