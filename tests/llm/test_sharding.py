from pii_spark.llm import sharding
from pii_spark.llm.queries import op8_byte_shards


def brute_force(rows, n):
    total, before, out, slots = sum(s for *_, s in rows), 0, [], {}
    for *key, size in sorted(rows):
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((*key, size, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_shards_equal_a_sequential_cut(spark):
    rows = [(i, 16 + i * i % 97) for i in range(500)] + [(500, 9000), (501, 16)]
    df = spark.createDataFrame(rows, "doc_id long, size long").repartition(5)
    got = sorted(tuple(r) for r in sharding.shard_by_bytes(df, 7).select("doc_id", "size", "shard", "slot").collect())
    assert got == brute_force(rows, 7)


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 16), (3, 20), (3, 20), (3, 20)], "doc_id long, size long")
    got = sharding.shard_by_bytes(df, 2).collect()
    assert len(got) == 4 and {r["shard"] for r in got} == {0, 1}
    assert [r["shard"] for r in got if r["doc_id"] is None] == [0]
    assert sharding.shard_by_bytes(df.limit(0), 2).count() == 0


def test_query_over_the_small_tables(spark, tmp_path, make_docs):
    import zlib

    texts = [(i, "é" * (i % 50) * (40 if i % 30 == 0 else 1)) for i in range(1, 400)] + [(0, None), (400, "")]
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_byte_shards(spark, str(tmp_path)).collect()
    rows = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in texts]
    want = brute_force(rows, 40)
    assert sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == sorted(want)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_columns_of_any_name_pass_through(spark):
    rows = [(i, 7 - i, "x", 16 + i, 99) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, _range long, _place string, size long, shard long")
    out = sharding.shard_by_bytes(df, 3)
    assert out.columns == ["doc_id", "_range", "_place", "size", "shard", "slot"]
    assert sorted((r["doc_id"], r["_range"], r["_place"], r["size"]) for r in out.collect()) == [r[:4] for r in rows]
    assert {r["shard"] for r in out.collect()} <= {0, 1, 2}
