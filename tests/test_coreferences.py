"""Linked mentions against a plain, sequential version."""

import random
import re

from pii_spark.operators import normalize

SCHEMA = f"id int, text string, privacy_mask {normalize.MASK}, coreferences {normalize.CLUSTERS}"


def spots(text, value):
    return [i for i in range(len(text)) if value and text.startswith(value, i)]


def word_spots(text, value):
    if not value:
        return []
    word = rf"\b{re.escape(value)}\b"
    return [m.start() for m in re.finditer(word, text)] or [m.start() for m in re.finditer(word, text, re.IGNORECASE)]


def linked(text, mask, clusters):
    """Label entries (start, value, labels) and relations (from, to), mention by mention."""
    entries, ids, used, mentioned = [], {}, set(), {}

    def add(value, at, labels):
        entries.append((at, value, labels))
        ids[value, at] = len(entries)
        return len(entries)

    for value, label in mask:
        free = [p for p in spots(text, value) if p not in used]
        if free:
            used.add(free[0])
            add(value, free[0], [label])
    for kind, mentions in clusters:
        label = {"person": "PRONOUN", "organization": "REFERENCE"}.get((kind or "").lower(), "MENTION")
        for value, labels in mentions:
            found, head = [], value.split()
            for p in word_spots(text, value) if labels else ():
                near = any(
                    abs(q - p) < 20 and (other, q) in ids for other, own in mask if own in labels for q in spots(text, other)
                )
                if (value, p) not in ids and near:
                    found.append(add(value, p, []))
            for p in word_spots(text, value):
                if (value, p) in ids:
                    found.append(ids[value, p])
                elif len(head) > 1 and (head[0], p) in ids:
                    found.append(add(value, p, []))
                elif p not in used:
                    used.add(p)
                    found.append(add(value, p, [label]))
            if found:
                mentioned.setdefault(value, []).extend(found)
    relations = []
    for _, mentions in clusters:
        chain = []
        for value, _ in mentions:
            chain += mentioned.get(value) or [ids[value, p] for p in word_spots(text, value) if (value, p) in ids]
        relations += [(f"ent-{other}", f"ent-{chain[0]}") for other in chain[1:]]
    return entries, relations


def got(spark, rows):
    data = [
        (
            i, text, None if mask is None else [(v, label, None, None) for v, label in mask],
            None if clusters is None else [(j, kind, [(v, None, labels) for v, labels in ms]) for j, (kind, ms) in enumerate(clusters)],
        )
        for i, (text, mask, clusters) in enumerate(rows)
    ]
    out = normalize.link_coreferences(spark.createDataFrame(data, SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    results = []
    for r in sorted(out.collect(), key=lambda r: r.id):
        result = r.predictions[0].result
        labels = [x for x in result if x.type == "labels"]
        assert [x.id for x in labels] == [f"ent-{i + 1}" for i in range(len(labels))]
        assert all(x.direction == "right" for x in result if x.type == "relation")
        results.append((
            [(x.value.start, x.value.text, list(x.value.labels)) for x in labels],
            [(x.from_id, x.to_id) for x in result if x.type == "relation"],
        ))
    return results


def test_mentions_of_a_sample(spark):
    text = "Ann Lee called. She said Ann is here."
    mask = [("Ann", "FIRSTNAME"), ("Lee", "SURNAME")]
    rows = [
        (text, mask, [("person", [("Ann Lee", None), ("she", []), ("He", None)])]),
        ("it is it", [], [("organization", [("it", None)])]),
        ("The boss Ann", [("Ann", "FIRSTNAME")], [(None, [("The boss", ["FIRSTNAME"])])]),
        (None, mask, [("person", [("Ann", None)])]), ("", [], []), (text, None, None), (text, mask, None),
    ]
    out = got(spark, rows)
    assert out[0] == ([(0, "Ann", ["FIRSTNAME"]), (4, "Lee", ["SURNAME"]), (0, "Ann Lee", []), (16, "she", ["PRONOUN"])], [("ent-4", "ent-3")])
    assert out[1] == ([(0, "it", ["REFERENCE"]), (6, "it", ["REFERENCE"])], [("ent-2", "ent-1")])
    assert out[2][0][1] == (0, "The boss", [])
    assert out[3] == out[4] == out[5] == ([], [])


def test_random_samples_equal_the_sequential_version(spark):
    rng, rows = random.Random(12), []
    words = ["Ann", "ann", "Lee", "Ann Lee", "Lee Ann", "she", "She", "it", "Bo"]
    for _ in range(150):
        text = rng.choice([" ", ", ", "  "]).join(rng.choices(words, k=rng.randint(0, 14)))
        mask = [(rng.choice(words), rng.choice("XYZ")) for _ in range(rng.randint(0, 5))]
        clusters = [
            (rng.choice(["person", "Organization", "other", None]),
             [(rng.choice(words), rng.choice([None, [], ["X"], ["X", "Y"]])) for _ in range(rng.randint(0, 4))])
            for _ in range(rng.randint(0, 3))
        ]
        rows.append((text, mask, clusters))
    for row, result in zip(rows, got(spark, rows), strict=True):
        assert result == linked(*row), row
