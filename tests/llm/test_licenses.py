import random
import re

from pii_spark.llm import licenses
from pii_spark.llm.queries import op12_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = (("x", "a b c d e f g h"), ("y", "c d e f z"), ("z", "a b c d a b c d"), ("y", "q r s t"))
PHRASES = (("p", "a b"), ("q", "b c d"), ("p", "b"))


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrases):
    found = []
    for label, phrase in phrases:
        p = words_of(phrase)
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def longest_runs(words, templates, least):
    """Per template, all (end, length) of runs that no neighbour extends, by brute force."""
    out = set()
    for k, (_, t) in enumerate(templates):
        t = words_of(t)
        for i in range(len(words)):
            for j in range(len(t)):
                if (i and j and words[i - 1] == t[j - 1]) or words[i] != t[j]:
                    continue
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                if n >= least:
                    out.add((k, i, i + n, j, j + n))
    return out


def best_cover(words, template, least, gap):
    """Most words of ``template`` that a chain of its runs covers; the chain by trying all of them."""
    runs = sorted((r[1:] for r in longest_runs(words, [("", template)], least)), key=lambda r: (r[1], r[0], r[2]))
    best = []
    for j, (a, b, c, d) in enumerate(runs):
        options = [b - a]
        for i, (_, b0, _, d0) in enumerate(runs[:j]):
            if b0 < b and d0 < d and a - b0 <= gap and c - d0 <= gap:
                options.append(best[i] + min(b - max(a, b0), d - max(c, d0)))
        best.append(max(options))
    return max(best, default=0)


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    automaton = licenses.build(SMALL, PHRASES, 2)
    for _ in range(300):
        words = rng.choices("abcdefghqrstz?", k=rng.randint(0, 40))
        n, found, matches = licenses.matched(automaton, iter([[w.encode() for w in words[:7]], [w.encode() for w in words[7:]]]))
        assert n == len(words) and sorted(found) == places(words, PHRASES)
        runs = {(k, *r) for k, rs in licenses.segments(automaton, matches).items() for r in rs}
        assert runs == longest_runs(words, SMALL, 2)
        for k, (_, template) in enumerate(SMALL):
            spans = licenses.chained(sorted((r[1:] for r in runs if r[0] == k), key=lambda r: (r[1], r[0], r[2])), 3)
            assert max((s[0] for s in spans), default=0) == best_cover(words, template, 2, 3)
            ends = sorted((a, b) for _, a, b in spans)
            assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))


def test_whole_texts_with_names_and_breaks_are_covered(spark):
    mit, bsd, apache = licenses.TEMPLATES[2][1], licenses.TEMPLATES[4][1], licenses.TEMPLATES[6][1]
    changed = mit.replace("any person", "any fine person").replace("Software", "Program", 1)
    rows = [
        (1, f"My own words. {mit} more"), (2, changed), (3, f"{bsd}\n\n{apache}"), (4, bsd[: len(bsd) // 2]), (5, None),
        (6, ""), (7, "  ?! "), (8, "ÀÉ the cc-BY x"), (9, f"{mit} " * 3), (9, f"{mit} " * 3), (None, "GNU general, public License"),
    ]
    df = spark.createDataFrame([(*r, "kept", 3) for r in rows], "doc_id long, text string, _row string, score int")
    out = licenses.scan_licenses(df)
    assert out.columns[:2] == ["doc_id", "_row"] and "text" not in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["labels"] == "mit" and got[1]["spans"][0]["first_word"] == 3 and got[1]["score"] == 1.0
    assert got[1]["base_labels"] == "" and got[1]["first_word"] is None
    assert got[2]["labels"] == "mit" and 0.95 < got[2]["score"] < 1
    assert got[3]["labels"] == "apache,apache-2.0,bsd" and got[3]["base_labels"] == "apache"
    assert got[4]["labels"] == "" and 0.4 < got[4]["score"] < 0.6
    for i in (5, 6, 7):
        assert tuple(got[i])[2:] == (0, 0, None, None, "", "", 0.0, [])
    assert (got[8]["n_words"], got[8]["first_word"], got[8]["labels"], got[8]["score"]) == (5, 2, "cc-by", 1.0)
    assert len(got[9]["spans"]) == 3 and out.where("doc_id = 9").count() == 2
    assert got[None]["labels"] == "gpl"
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_very_long_texts_in_pieces():
    automaton = licenses.build(licenses.TEMPLATES, licenses.PHRASES)
    lengths = [len(licenses.words_of(t.encode())) for _, t in licenses.TEMPLATES]
    for text in ("mit license " * 300_000, "the " * 1_000_000 + "MIT License", "x" * 3_000_000 + " mit license"):
        got = licenses.scan(automaton, licenses.TEMPLATES, lengths, text.encode())
        assert got["n_base"] == text.lower().count("mit license") and got["n_words"] == len(text.split())
        assert got["last_word"] == got["n_words"] - 2


def test_query_over_the_small_tables(spark, tmp_path, make_docs, words):
    rng, texts = random.Random(5), [(0, None), (1, "")]
    notes = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "GNU General Public License", "apache, licensE", "mit"]
    for i in range(2, 120):
        w = words(rng.randint(0, 60), i)
        for note in rng.sample(notes, rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), note)
        texts.append((i, rng.choice([" ", "\n", "-"]).join(w)))
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op12_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        own, r = words_of(text), got[i]
        base = places(own, licenses.PHRASES)
        labels = {label for _, label in base}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(own), len(base), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        shares = [(label, best_cover(own, t, 4, 16) / len(words_of(t))) for label, t in licenses.TEMPLATES]
        labels |= {label for label, share in shares if share >= licenses.MIN_SHARE}
        assert r["labels"] == ",".join(sorted(labels))
        assert r["score"] == (1.0 if base else max(share for _, share in shares))
