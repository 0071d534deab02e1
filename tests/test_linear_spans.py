"""Span work in long texts: the same results as plain Python, and times that grow with the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pii_spark.functions import offsets, spans
from pii_spark.operators import detect, mask, normalize, prepare, review, vault

SPANS = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"
MASK = "array<struct<value:string,label:string,start:int,end:int>>"


def folded(text, items, policy):
    """The fold over all spans, one after the other."""
    out = []
    for s in sorted(items, key=lambda s: (s[2], -s[3], s[1], -s[4])):
        if not out or s[2] >= out[-1][3]:
            out.append(s)
            continue
        last = out[-1]
        longer = (text[last[2]:s[3]], last[1], last[2], s[3])
        if policy == "confidence" and s[2:4] == last[2:4]:
            out[-1] = s if s[4] > last[4] else last
        elif s[1] == last[1]:
            if s[3] > last[3]:
                out[-1] = (*longer, (last[4] + s[4]) / 2 if policy == "confidence" else max(last[4], s[4]))
        elif policy == "confidence":
            out[-1] = s if s[4] > last[4] else last
        elif s[3] - s[2] > last[3] - last[2]:
            out[-1] = s
    return out


def drawn(rng, text, n):
    items = []
    for _ in range(n):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randint(1, 12))
        items.append((text[a:b], rng.choice("ABC"), a, b, rng.randint(1, 9) / 10))
    return items


@pytest.mark.parametrize("policy", ["confidence", "longest"])
def test_merge_equals_one_fold(spark, policy):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 2, 5, 30, 200, 600):
        text = "".join(rng.choices("ab cé😀", k=max(5, 6 * n)))
        rows.append((text, drawn(rng, text, n)))
    df = spark.createDataFrame(rows, f"t string, s {SPANS}")
    for row in df.select("t", "s", spans.merge_spans(F.col("s"), policy).alias("m")).collect():
        want = folded(row.t, [tuple(x) for x in row.s], policy)
        assert [tuple(x)[:4] for x in row.m] == [x[:4] for x in want]
        assert [x.confidence for x in row.m] == pytest.approx([x[4] for x in want])


def test_cuts_across_pages(spark):
    text = "é😀x" * 1000 + "end"
    cuts = [(0, 0), (0, 1), (5, 1024), (1023, 1025), (1024, 2048), (1000, 3003), (3002, 3003), (2048, 2048), (0, 3003), (7, 3)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    cut = offsets.bind(offsets.pages_sql("t"), "pages", offsets.cut_sql("pages", "a", "b"))
    assert [r.c for r in df.selectExpr(f"{cut} AS c").collect()] == [text[a:b] for a, b in cuts]


def test_masking_a_long_text(spark):
    rng = random.Random(8)
    parts, items, at = [], [], 0
    for i in range(3000):
        gap = "".join(rng.choices("ab é😀\n", k=rng.randint(0, 9)))
        value = f"v{i % 700}"
        parts += [gap, value]
        items.append((value, "AGE", at + len(gap), at + len(gap) + len(value), 1.0, f"<{i % 500}>"))
        at += len(gap) + len(value)
    text, want, last = "".join(parts), [], 0
    for value, _, a, b, _, dummy in items:
        want += [text[last:a], dummy]
        last = b
    df = spark.createDataFrame([(text, items)], "t string, s array<struct<text:string,label:string,start:int,end:int,confidence:double,dummy:string>>")
    row = df.select(
        spans.replace_spans(F.col("t"), F.col("s")).alias("r"), spans.masked_to_original(F.col("s")).alias("m"),
        spans.restore_by_span(spans.replace_spans(F.col("t"), F.col("s")), F.col("s")).alias("b"),
    ).first()
    assert row.r == "".join([*want, text[last:]]) and row.b == text
    first = {}
    for value, *_, dummy in items:
        first.setdefault(dummy, value)
    assert row.m == first


def test_overlaps_are_dropped_as_by_one_greedy_choice(spark):
    rng = random.Random(6)
    rows = []
    for n in (0, 1, 40, 300):
        items = [(t, label, a, b) for t, label, a, b, _ in drawn(rng, "x" * (5 * n + 20), n)]
        rows.append((n, items))
    for row in spark.createDataFrame(rows, f"n int, m {MASK}").select("m", prepare.drop_overlaps(F.col("m")).alias("k")).collect():
        kept = []
        for e in sorted(row.m, key=lambda e: (e.start - e.end, e.start, e.label)):
            if not any(e.start < y.end and y.start < e.end for y in kept):
                kept.append(e)
        assert [tuple(e) for e in row.k] == sorted((tuple(e) for e in kept), key=lambda e: -e[2])


def test_claims_equal_one_after_the_other(spark):
    rng = random.Random(1)
    rows = []
    for n in (0, 1, 10, 60):
        text = "".join(rng.choices("ab ", k=3 * n + 2))
        values = [text[a:a + rng.randint(0, 3)] for a in (rng.randrange(len(text)) for _ in range(n))] + ["zz"]
        rows.append((text, [(v, f"L{i}", None, None) for i, v in enumerate(values)]))
    df = spark.createDataFrame(rows, f"t string, m {MASK}")
    for row in df.select("t", "m", normalize.claimed_entities(F.col("t"), F.col("m")).alias("c")).collect():
        used, want = set(), []
        for e in row.m:
            spots = [i for i in range(len(row.t)) if e.value and row.t.startswith(e.value, i) and i not in used]
            if spots:
                used.add(spots[0])
                want.append((f"ent-{len(want) + 1}", spots[0], e.value, e.label))
        assert [(c.id, c.value.start, c.value.text, c.value.labels[0]) for c in row.c] == want


def test_maps_and_differences_of_many_entries(spark):
    rng = random.Random(3)
    pairs = [(1, f"t{rng.randint(0, 50)}", f"d{rng.randint(0, 50)}") for _ in range(400)]
    row = vault.document_maps(spark.createDataFrame(pairs, "doc_id long, text string, dummy string")).first()
    known = sorted({p[1:] for p in pairs})
    assert row.to_dummy == {t: min(d for u, d in known if u == t) for t, _ in known}
    assert row.to_original == {d: min(t for t, u in known if u == d) for _, d in known}
    sides = [[(f" v{rng.randint(0, 80)} ", rng.choice("ABC"), 0, 0) for _ in range(n)] for n in (90, 70)]
    a, b = (spark.createDataFrame([("f", s)], f"file_name string, privacy_mask {MASK}") for s in sides)
    issues = review.diff_annotations(a, b).first().issues
    want = []
    labels = [{v: [x[1] for x in s if x[0].strip() == v] for v in {x[0].strip() for x in s}} for s in sides]
    for value, label, *_ in sides[0]:
        other = labels[1].get(value.strip(), [])
        if not other:
            want.append(("EXTRA", value.strip(), label, None))
        elif label not in other:
            want.append(("WRONG_LABEL", value.strip(), label, other[0]))
    want += [("MISSING", v.strip(), None, label) for v, label, *_ in sides[1] if v.strip() not in labels[0]]
    assert [tuple(i)[:4] for i in issues] == want


def test_time_grows_with_the_number_of_spans(spark):
    """Four times the spans in one text: about four times the time, far from sixteen."""

    def seconds(n):
        text = " ".join(f"mail a{i}@x{i % 97}.org or 10.0.{i // 250 % 250}.{i % 250}, said é" for i in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = mask.mask_text(detect.detect_rules(df))
        began = time.time()
        row = found.selectExpr("size(entities) AS n", "size(masked_to_original) AS m", "md5(masked_text) AS d").first()
        assert row.n == n
        return time.time() - began

    seconds(1000)
    assert seconds(16000) / seconds(4000) < 8
