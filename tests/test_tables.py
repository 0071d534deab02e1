"""Vault, ranking, evaluation and review over small tables, against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pii_spark.functions.ranking import exact_percentiles, mark_smallest
from pii_spark.operators import evaluate, prepare, profiling, review, synth, vault

T0 = datetime(2024, 1, 1)
HITS = "original_pii string, dummy_pii string, pii_type string, confidence double, ts timestamp"


def hits(spark, *rows):
    return spark.createDataFrame([(*r[:4], T0 + timedelta(minutes=r[4])) for r in rows], HITS)


def test_upsert_keeps_dummy_and_counts(spark):
    first = vault.vault_build(hits(spark, ("ann", "eve", "FIRSTNAME", 0.8, 0), ("ann", "eve", "FIRSTNAME", 0.7, 5)))
    row = vault.vault_upsert(first, hits(spark, ("ann", "zoe", "SURNAME", 0.95, 9), ("bob", "kim", "FIRSTNAME", 0.5, 1))).collect()
    got = {r.original_pii: r for r in row}
    assert len(got) == 2
    ann = got["ann"]
    assert (ann.dummy_pii, ann.pii_type, ann.confidence, ann.access_count) == ("eve", "FIRSTNAME", 0.95, 3)
    assert ann.created_at == T0 and ann.last_accessed_at == T0 + timedelta(minutes=9)
    assert got["bob"].access_count == 1 and got["bob"].id != ann.id


def test_expire_delete_lookup_trim(spark):
    v = vault.vault_build(hits(spark, ("old", "a", "X", 1.0, 0), ("new", "b", "X", 1.0, 110)))
    now = F.lit(T0 + timedelta(minutes=120)).cast("timestamp")
    assert [r.original_pii for r in vault.vault_expire(v, now, "1 hour").collect()] == ["new"]
    assert vault.vault_expired_count(v, now, "1 hour").first().removed == 1
    keys = spark.createDataFrame([("old",), ("nope",)], "original_pii string")
    assert [r.original_pii for r in vault.vault_delete(v, keys).collect()] == ["new"]
    look = spark.createDataFrame([("b",), ("zz",)], "key string")
    assert {r.key: r.found for r in vault.vault_lookup(look, v, "to_original").collect()} == {"b": "new", "zz": None}
    assert [r.original_pii for r in vault.vault_trim(v, 1).collect()] == ["new"]
    assert vault.vault_count(v).first().rows == 2


def test_many_distinct_originals(spark):
    assert vault.vault_build(hits(spark, *[(f"o{i}", f"d{i}", "X", 1.0, i) for i in range(20)])).count() == 20


def test_resolve_frees_shared_dummies(spark):
    rows = [(f"person {i}", "same", "EMAIL", 1.0, i) for i in range(30)]
    rows += [(f"town {i}", "York", "CITY", 1.0, i) for i in range(90)]
    out = vault.vault_resolve(vault.vault_build(hits(spark, *rows)), rounds=4).collect()
    assert len(out) == 120
    assert len({r.dummy_pii for r in out}) == len(out)
    assert sum(not r.suffixed for r in out if r.pii_type == "EMAIL") >= 29
    # The pool of cities is smaller than the towns: some need a suffix.
    assert any(r.suffixed for r in out if r.pii_type == "CITY")


def test_mark_smallest_matches_a_sort(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("p"))
    h = F.md5(F.col("id").cast("string"))
    rows = df.withColumn("h", h).collect()
    got = {r.id for r in mark_smallest(df, h, lambda n: F.floor(n * 0.3), "id").where("chosen").collect()}
    assert got == {r.id for r in sorted(rows, key=lambda r: r.h)[:1500]}
    out = mark_smallest(df, h, lambda n: F.floor(n * 0.1), "id", by=["g"], first=F.col("p"))
    got = {r.id for r in out.where("chosen").collect()}
    want = set()
    for g in range(3):
        part = sorted((r for r in rows if r.g == g), key=lambda r: (r.p, r.h))
        want |= {r.id for r in part[: len(part) // 10]}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 9, 40_000])
def test_percentiles_with_a_hot_value(spark, n):
    rng = random.Random(n)
    values = [5.0 if rng.random() < 0.34 else round(rng.expovariate(0.01), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.fraction: r.percentile for r in exact_percentiles(df, "v", [0.5, 0.95, 0.99]).collect()}
    for f in (0.5, 0.95, 0.99):
        assert got[f] == pytest.approx(float(np.percentile(values, f * 100)))


def test_latency_of_nothing(spark):
    empty = spark.createDataFrame([], "ms double")
    assert evaluate.latency_percentiles(empty, "ms").count() == 0


@pytest.mark.parametrize("ratio,sizes", [(0.0, 0), (0.001, 1), (0.25, 25), (1.0, 99)])
def test_split_sizes(spark, ratio, sizes):
    s = prepare.split_random(spark.range(100).withColumnRenamed("id", "k"), "k", ratio)
    assert s.where("split = 'validation'").count() == sizes and s.count() == 100


def test_balanced_split_covers_rare_labels(spark):
    rows = [(i, ["COMMON"] + (["RARE"] if i % 250 == 0 else [])) for i in range(1000)] + [(1000 + i, []) for i in range(10)]
    s = prepare.split_balanced(spark.createDataFrame(rows, "k long, types array<string>"), "k", "types", 0.1).collect()
    chosen = {r.k for r in s if r.split == "validation"}
    assert len(chosen) == 101 and chosen & {0, 250, 500, 750}
    assert len(s) == 1010


def test_class_weights(spark):
    df = spark.createDataFrame([(["O"] * 8 + ["B-X", "IGNORE"],), (["B-Y"] * 4,)], "tags array<string>")
    got = {r.tag: r.weight for r in prepare.class_weights(df).collect()}
    x, y = (13 / (3 * 1)) ** 0.5, (13 / (3 * 4)) ** 0.5
    assert got["O"] == 1.0 and got["B-X"] == pytest.approx(x / ((x + y) / 2), abs=1e-5)
    assert "IGNORE" not in got


def greedy(gold, predicted):
    """All pairs, largest overlap first: the definition."""
    gold, predicted = sorted(set(gold)), sorted(set(predicted))
    pairs = sorted(
        ((min(g[1], p[1]) - max(g[0], p[0]), i, j) for i, g in enumerate(gold) for j, p in enumerate(predicted)
         if g[2] == p[2] and min(g[1], p[1]) > max(g[0], p[0])), reverse=True)
    a, b = set(), set()
    for _, i, j in pairs:
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
    return sorted([(g[2], "tp" if i in a else "fn") for i, g in enumerate(gold)]
                  + [(p[2], "fp") for j, p in enumerate(predicted) if j not in b])


span = st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("AB")).map(lambda t: (t[0], t[0] + t[1], t[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(span, max_size=9), st.lists(span, max_size=9))
def test_overlap_matching(gold, predicted):
    assert sorted(evaluate.match_overlaps(gold, predicted)) == greedy(gold, predicted)


def test_prf_and_sets(spark):
    e = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"
    gold = spark.createDataFrame([(1, [("a", "X", 0, 1, 1.0), ("a", "X", 0, 1, 1.0), ("b", "Y", 2, 3, 1.0)]), (2, [])], f"doc_id long, entities {e}")
    pred = spark.createDataFrame([(1, [("a", "X", 0, 1, 0.3)]), (3, [("z", "X", 0, 4, 0.3)])], f"doc_id long, entities {e}")
    pairs = evaluate.pair_spans(gold, pred)
    got = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in evaluate.add_prf(evaluate.span_confusion(pairs)).collect()}
    assert got == {"X": (1, 1, 0, 0.6667), "Y": (0, 0, 1, 0.0)}
    m = evaluate.micro_macro(evaluate.span_confusion(pairs)).first()
    assert m.micro_f1 == 0.5 and m.macro_f1 == pytest.approx(0.6667 / 2, abs=1e-4)


def test_strict_chunks(spark):
    cases = {
        ("B-A", "I-A", "O", "I-A", "B-B", "I-A", "B-A", "B-A"): [(0, 2, "A"), (4, 5, "B"), (6, 7, "A"), (7, 8, "A")],
        (): [], ("I-A", "I-A"): [], ("B-A",): [(0, 1, "A")],
    }
    for tags, want in cases.items():
        df = spark.createDataFrame([(list(tags),)], "t array<string>")
        got = df.select(evaluate.strict_chunks(F.col("t")).alias("c")).first().c
        assert [(c.start, c.end, c.label) for c in got] == want


def test_status_buckets(spark):
    df = spark.createDataFrame([(200,), (299,), (302,), (404,), (503,), (None,)], "status int")
    assert tuple(evaluate.status_buckets(df).first()) == (2, 1, 1, 1, 1)


def test_diff_and_ledger(spark):
    m = "file_name string, privacy_mask array<struct<value:string,label:string,start:int,end:int>>"
    own = spark.createDataFrame([("a", [(" Ann ", "CITY", 0, 3), ("x", "AGE", 0, 1)]), ("b", [("q", "ZIP", 0, 1)])], m)
    other = spark.createDataFrame([("a", [("Ann", "FIRSTNAME", 0, 3), ("new", "URL", 5, 8)]), ("b", [("q", "ZIP", 0, 1)])], m)
    reviews = review.diff_annotations(own, other)
    issues = sorted((i.file_name, i.issue_type, i.value, i.suggested_label) for i in review.explode_issues(reviews).collect())
    assert issues == [("a", "EXTRA", "x", None), ("a", "MISSING", "new", "URL"), ("a", "WRONG_LABEL", "Ann", "FIRSTNAME")]
    lines = review.ledger_rows(reviews)
    old = spark.createDataFrame([("b", "DIRTY", 2, "?"), ("c", "CLEAN", 0, "")], "file_name string, status string, issue_count int, issues string")
    merged = {r.file_name: r.status for r in review.merge_ledger(old, lines).collect()}
    assert merged == {"a": "DIRTY", "b": "CLEAN", "c": "CLEAN"}


def test_top_values_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([([("A", "x"), ("A", "y"), ("A", "x")],)], "entities array<struct<label:string,value:string>>")
    top = profiling.top_values(df, 1)
    assert [(r.value, r.n) for r in top.collect()] == [("x", 2)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_synthesis_is_exact_and_repeatable(spark):
    ids = spark.range(750).withColumnRenamed("id", "k")
    a, b = synth.synthesize(ids, "k").collect(), synth.synthesize(ids.repartition(7), "k").collect()
    assert {r.k: r.text for r in a} == {r.k: r.text for r in b}
    for r in a:
        assert r.entities and all(r.text[e.start:e.end] == e.text for e in r.entities) and "{" not in r.text
    cover = synth.label_coverage(synth.synthesize(ids, "k"), profiling.labels_dimension(spark), 5).collect()
    assert len(cover) == 26 and not any(r.under_represented for r in cover)


def test_label_draw_closes_addresses(spark):
    from pii_spark.functions import fixed_values as fv

    rows = synth.sample_labels(spark.range(200).withColumnRenamed("id", "k"), "k", 4).collect()
    for r in rows:
        hit = set(r.labels) & set(fv.ADDRESS_LABELS)
        assert len(r.labels) >= 4 and (not hit or hit == set(fv.ADDRESS_LABELS))
    named = sum("SURNAME" in r.labels for r in rows)
    assert named > sum("IBAN" in r.labels for r in rows)


def test_running_counts_in_ranges(spark):
    """Many cells of one group: the windows run over ranges, and the totals are those of one scan."""
    from pii_spark.functions.ranking import running_counts

    rows = [("big" if i % 3 else f"g{i % 5}", i * 7919 % 5000, i % 4 + 1) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, f long, c long")
    got = {(r.g, r.f): (r["_upto"], r["_total"]) for r in running_counts(df, ["g"], ["f"], "c").collect()}
    totals, want = {}, {}
    for g, f, c in sorted(rows):
        totals[g] = totals.get(g, 0) + c
        want[g, f] = totals[g]
    assert got == {k: (v, totals[k[0]]) for k, v in want.items()}
    assert running_counts(df.limit(0), ["g"], ["f"], "c").count() == 0
