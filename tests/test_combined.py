"""Dictionary phrases and one entity list from several detectors, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pii_spark.operators import combine, detect, mask, phrases



def words_of(text):
    found = list(re.finditer(r"[\w']+", text))
    return [(m.group(), m.start(), m.end()) for m in found]


def plain(gap):
    return re.sub(r"\s+", " ", gap)


def matches(text, entries):
    own, out = words_of(text), []
    for value, label in set(entries):
        want = words_of(value)
        for p in range(len(own) - len(want) + 1) if want else ():
            run = own[p : p + len(want)]
            if [w[0] for w in run] == [w[0] for w in want] and all(
                plain(text[run[k][2] : run[k + 1][1]]) == plain(value[want[k][2] : want[k + 1][1]]) for k in range(len(run) - 1)
            ):
                out.append((run[0][1], run[-1][2], label))
    kept = []
    # Entries of equal words, with the same between them, are one.
    for s, e, label in sorted(set(out), key=lambda m: (m[0], -m[1], m[2])):
        if not kept or s >= kept[-1][1] or (s, e) == kept[-1][:2]:
            kept.append((s, e, label))
    return [(text[s:e], label, s, e) for s, e, label in kept]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["text"], r["label"], r["start"], r["end"]))
    return {k: sorted(v, key=lambda x: x[1:]) for k, v in out.items()}


def test_phrases(spark):
    entries = [
        ("New York", "CITY"), ("New York", "STATE"), ("York", "CITY"), ("New York City Hall", "STREET"), ("O'Brien-Smith", "SURNAME"),
        ("Bank of", "COMPANYNAME"), ("of  the\tNew", "X"), ("...", "X"), ("", "X"), (" Élan vital!", "X"), (None, "X"), ("absent here", "X"),
    ]
    texts = [
        (1, "In New York and New\n  York, York; NewYork"), (2, "New York City Hall, new York"), (3, "O'Brien-Smith O'Brien Smith"),
        (4, "Bank of of the New York"), (5, None), (6, ""), (7, "Élan  vital. 😀 New, York"), (8, "York " * 3000 + "New York"),
    ]
    docs = spark.createDataFrame([(*t, "kept") for t in texts], "doc_id long, text string, start string")
    got = found(phrases.detect_phrases(docs, spark.createDataFrame(entries, "value string, label string")))
    want = {i: sorted(m, key=lambda x: x[1:]) for i, t in texts if (m := matches(t or "", [e for e in entries if e[0]]))}
    assert got == want
    assert phrases.detect_phrases(docs.limit(0), spark.createDataFrame(entries, "value string, label string")).count() == 0
    assert phrases.detect_phrases(docs, spark.createDataFrame([], "value string, label string")).count() == 0


def test_random_phrases(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "ab", "é"]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "-", ", "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    entries = [("".join(rng.choice(vocabulary) + rng.choice([" ", "-"]) for _ in range(rng.randint(1, 4))), rng.choice("XY")) for _ in range(40)]
    got = found(phrases.detect_phrases(
        spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(entries, "value string, label string")
    ))
    assert got == {i: sorted(m, key=lambda x: x[1:]) for i, t in texts if (m := matches(t, entries))}


def test_one_list_from_all_detectors(spark):
    def model():
        def find(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError("no")
            return [
                [
                    {"text": m.group(), "label": "FIRSTNAME", "start": m.start(), "end": m.end(), "confidence": 0.9}
                    for m in re.finditer("Ann York|ann", t)
                ]
                for t in texts
            ]

        return find

    rows = [
        (1, "Ann York of New York, ann@x.org"), (2, "fail ann@x.org in New York"), (3, None), (4, "nothing"), (5, "ann " * 2000 + "New York"),
    ]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, error string")
    places = spark.createDataFrame([("New York", "CITY"), ("York", "CITY")], "value string, label string")
    out = combine.detect_combined(docs.coalesce(1), gazetteer=places, load=model)
    got = {r["doc_id"]: [(e["text"], e["label"]) for e in r["entities"]] for r in out.collect()}
    assert got[1] == [("Ann York", "FIRSTNAME"), ("New York", "CITY"), ("ann@x.org", "EMAIL")]
    assert got[2] == [("ann@x.org", "EMAIL"), ("New York", "CITY")] and got[3] == got[4] == []
    assert len(got[5]) == 2001
    assert {r["doc_id"] for r in out.where("error IS NOT NULL").collect()} == {2}
    masked = {r["doc_id"]: r for r in mask.mask_text(out).collect()}
    assert "York" not in masked[1]["masked_text"] and "ann@" not in masked[1]["masked_text"]
    assert masked[3]["masked_text"] is None and masked[4]["masked_text"] == "nothing"


def test_entity_rows_of_several_detectors(spark):
    schema = "doc_id long, text string, label string, start int, end int, confidence double"
    a = spark.createDataFrame([(1, "ab", "X", 0, 2, 0.5), (1, "f", "X", 9, 10, 0.1), (2, "q", "Y", 3, 4, 0.6)], schema)
    b = spark.createDataFrame([(1, "bc", "Y", 1, 3, 0.7), (1, "d", "Z", 5, 6, 0.7)], schema)
    out = combine.combine_entities(a, b, threshold=0.25)
    got = {r["doc_id"]: [(e["text"], e["label"]) for e in r["entities"]] for r in out.collect()}
    assert got == {1: [("bc", "Y"), ("d", "Z")], 2: [("q", "Y")]}
    assert combine.combine_entities(a.limit(0), b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        combine.combine_entities(a, threshold=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write("x")
        return lambda texts: [[] for _ in texts]

    df = spark.range(40).selectExpr("id AS doc_id", "'t' AS text", "id AS found").repartition(20)
    out = detect.detect_with_model(df, load)
    assert out.columns == ["doc_id", "text", "found", "entities", "error"] and out.where("found = doc_id").count() == 40
    assert out.select(F.sum(F.size("entities"))).first()[0] == 0
    with open(loads) as f:
        # Two runs of 20 tasks; how many workers serve them is up to Spark.
        assert len(f.read()) <= 24
