import zlib
from hashlib import sha256

from pii_spark.llm import merkle
from pii_spark.llm.queries import op11_merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(nodes, place):
    out = []
    for level in nodes[:-1]:
        run, at = level[place // 16 * 16 : place // 16 * 16 + 16], place % 16
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        place //= 16
    return out


def brute_force(rows):
    """``rows``: (doc_id, tree, leaf, offered)."""
    trees = {}
    for doc_id, tree, leaf, offered in rows:
        trees.setdefault(tree, []).append((doc_id is not None, doc_id or 0, leaf, offered))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: levels([r[2] for r in sorted(trees[s], key=lambda r: r[:3])]) for s in names}
    high, out = levels([low[s][-1][0] for s in names]), []
    for i, s in enumerate(names):
        for place, (there, doc_id, leaf, offered) in enumerate(sorted(trees[s], key=lambda r: r[:3])):
            sides = way(low[s], place) + way(high, i)
            digest = offered or leaf
            for a, b in sides:
                digest = h(a + digest + b)
            proof = h("".join(a + b for a, b in sides))
            root = high[-1][0]
            out.append((doc_id if there else None, leaf, low[s][-1][0], root, proof, digest, digest == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def got(df):
    return ordered(df.select("doc_id", *merkle.MADE).collect())


SCHEMA = "doc_id long, source string, leaf string, offered string, _tree string, root int"


def test_trees_of_many_sizes_equal_a_sequential_build(spark):
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "é": 257, "z": 256, "big": 4097, "whole": 4096}
    sizes |= {f"s{i}": 1 for i in range(20)}
    rows = [
        (i, s, h(f"{s}{i}"), h(f"other{i}") if i % 7 == 0 else (h(f"{s}{i}") if i % 11 == 0 else None))
        for s, n in sizes.items() for i in range(n)
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(6)
    out = merkle.manifest(df)
    assert out.columns == ["doc_id", "source", "_tree", *merkle.MADE]
    assert got(out) == ordered(brute_force(rows))


def test_lone_trees_ties_nulls_and_empty_tables(spark):
    def check(rows):
        assert got(merkle.manifest(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA))) == ordered(brute_force(rows))

    check([(1, "a", h("1"), None)])
    check([(1, "a", h("1"), h("2"))])
    check([(i, None, h(str(i)), None) for i in range(5)])
    check([(None, "a", h("1"), None), (3, "a", h("2"), None), (3, "a", h("1"), h("x")), (3, "b", h("2"), None)])
    same = merkle.manifest(spark.createDataFrame([(7, "a", h("1"), None, "x", 5)] * 40, SCHEMA)).collect()
    assert len(same) == 40 and {r["root"] for r in same} == {levels([h("1")] * 40)[-1][0]} and all(r["verified"] for r in same)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sweeps_inside_a_block():
    digests = [h(str(i)) for i in range(300)]
    nodes = merkle.swept_up(digests, 3)
    assert nodes == levels(digests)
    for place, sides in enumerate(merkle.swept_down(nodes, (("l", "r"),))):
        assert list(sides) == [*way(nodes, place), ("l", "r")]


def test_query_over_the_small_tables(spark, tmp_path, make_docs):
    texts = [(i, f"Text {i} ÉÄ") for i in range(300)] + [(300, None), (301, ""), (302, "lower"), (303, "Ab " * 200_000)]
    docs = make_docs(texts, source="s")
    docs = docs.selectExpr(
        "doc_id", "text", "if(doc_id % 9 = 0, null, lang) AS lang",
        "CASE WHEN doc_id % 3 = 0 THEN 's' WHEN doc_id % 31 = 0 THEN null ELSE concat('t', doc_id % 5) END AS source",
        "if(doc_id % 8 = 0, null, n_chars) AS n_chars", "_key",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = []
    for r in docs.collect():
        ahead = "".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars"))
        low = None if r["text"] is None else r["text"].translate({i: i + 32 for i in range(65, 91)})
        chosen = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        rows.append((r["doc_id"], r["source"], h(ahead + field(r["text"])), h(ahead + field(low)) if chosen else None))
    out = got(op11_merkle(spark, str(tmp_path)))
    assert out == ordered(brute_force(rows))
    assert {r[-1] for r in out} == {True, False}
