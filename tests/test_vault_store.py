"""The vault on disk: what is rewritten, what stays, and what a reader sees."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pii_spark.operators import vault
from pii_spark.sources import readers, vault_store, writers
from pii_spark.streaming import streams

T = datetime(2024, 1, 1)
HITS = "original_pii string, dummy_pii string, pii_type string, confidence double, ts timestamp"


def hits(spark, names, at=0):
    return spark.createDataFrame([(n, f"d-{n}", "X", 0.5, T + timedelta(minutes=at)) for n in names], HITS)


def stored(spark, path, version=None):
    return {r.original_pii: r.asDict() for r in vault_store.read_store(spark, path, version).collect()}


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upserts_equal_the_whole_table(spark, tmp_path):
    path, first, second = str(tmp_path / "v"), [f"o{i % 60}" for i in range(100)], ["o3", "o3", "new"]
    vault_store.upsert_store(spark, path, hits(spark, first), buckets=8)
    before = files(path)
    vault_store.upsert_store(spark, path, hits(spark, second, 5))
    want = vault.vault_upsert(vault.vault_build(hits(spark, first)), hits(spark, second, 5))
    assert stored(spark, path) == {r.original_pii: r.asDict() for r in want.collect()}
    after = files(path)
    assert before.items() <= after.items()
    # Two originals touch two buckets at most; the others keep their files.
    assert 1 <= len(set(after) - set(before)) <= 2
    entries = vault_store._manifest(spark, path)
    assert sum(e["folder"] is not None and e["folder"].startswith("data/000000000000") for e in entries) >= 6
    assert entries[0]["rows"] == 61 and len(stored(spark, path, 0)) == 60


def test_deletion_expiry_clear_and_old_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    vault_store.upsert_store(spark, path, hits(spark, ["a", "b", "c"]), buckets=4)
    vault_store.upsert_store(spark, path, hits(spark, ["d"], 90))
    vault_store.delete_from_store(spark, path, spark.createDataFrame([("b",), ("b",), ("nobody",)], "original_pii string"))
    assert set(stored(spark, path)) == {"a", "c", "d"}
    vault_store.expire_store(spark, path, F.lit(T + timedelta(minutes=100)), "1 hour")
    assert set(stored(spark, path)) == {"d"} and len(vault_store.store_versions(spark, path)) == 4
    vault_store.drop_versions(spark, path)
    assert len(files(path)) == 1 and set(stored(spark, path)) == {"d"}
    vault_store.clear_store(spark, path)
    assert stored(spark, path) == {}
    vault_store.upsert_store(spark, path, hits(spark, ["z"]))
    assert set(stored(spark, path)) == {"z"}
    vault_store.drop_versions(spark, path)
    assert len(files(path)) == 1


def test_new_and_empty_stores(spark, tmp_path):
    path = str(tmp_path / "v")
    assert stored(spark, path) == {}
    vault_store.clear_store(spark, path)
    vault_store.upsert_store(spark, path, hits(spark, []))
    vault_store.delete_from_store(spark, path, hits(spark, ["x"]))
    assert stored(spark, path) == {}


def test_batches_count_once_and_failed_writes_leave_no_version(spark, tmp_path):
    path = str(tmp_path / "v")
    for _ in range(2):
        vault_store.upsert_store(spark, path, hits(spark, ["a"]), buckets=4, batch=7)
    vault_store.delete_from_store(spark, path, hits(spark, ["nobody"]))
    vault_store.upsert_store(spark, path, hits(spark, ["a"]), batch=6)
    assert stored(spark, path)["a"]["access_count"] == 1
    vault_store.upsert_store(spark, path, hits(spark, ["a"]), batch=8)
    bad = hits(spark, ["a", "q"]).withColumn("confidence", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        vault_store.upsert_store(spark, path, bad, batch=9)
    assert stored(spark, path)["a"]["access_count"] == 2 and "q" not in stored(spark, path)


def test_a_hot_original(spark, tmp_path):
    path = str(tmp_path / "v")
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 500)).alias("original_pii"),
        F.lit("d").alias("dummy_pii"), F.lit("X").alias("pii_type"), F.lit(0.5).alias("confidence"), F.lit(T).alias("ts"),
    )
    vault_store.upsert_store(spark, path, many, buckets=8)
    got = stored(spark, path)
    assert got["hot"]["access_count"] == 10_000 and sum(r["access_count"] for r in got.values()) == 30_000


def test_a_cleared_log_takes_new_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([(1, T), (2, T + timedelta(days=1))], "id long, timestamp timestamp")
    writers.write_log(log, path)
    writers.clear_log(spark, path)
    assert readers.read_log(spark, path).count() == 0
    writers.write_log(log, path)
    assert sorted(r.id for r in readers.read_log(spark, path).collect()) == [1, 2]


def test_keys_go_when_they_are_idle(spark, tmp_path):
    """Every hit keeps a key alive, in whatever micro-batch it comes."""
    source, path = str(tmp_path / "h"), str(tmp_path / "v")

    def run(rows):
        spark.createDataFrame([(n, "d", "X", 0.5, T + timedelta(minutes=m)) for n, m in rows], HITS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(HITS).parquet(source)
        streams.vault_stream(spark, stream, path, str(tmp_path / "c"), buckets=4, availableNow=True).awaitTermination()
        streams.vault_idle_stream(
            spark, stream, path, str(tmp_path / "i"), "1 hour", "0 seconds", availableNow=True).awaitTermination()
        return set(stored(spark, path))

    assert run([("old", 0), ("kept", 0), ("kept", 50)]) == {"old", "kept"}
    assert run([("kept", 100), ("back", 70)]) == {"kept", "back"}
    # In one micro-batch, a key falls idle and comes back.
    assert run([("back", 200), ("late", 300)]) == {"late"}
    versions = vault_store.store_versions(spark, path)
    assert run([]) == {"late"} and vault_store.store_versions(spark, path) == versions
