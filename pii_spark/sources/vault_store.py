"""The vault on disk, in hash buckets: a write rewrites the buckets it touches and shares the rest.

``data/`` holds folders of buckets, one for each write. ``versions/N`` lists the folder of every bucket
that has rows, so that a reader sees one version as a whole, and a write that fails leaves the version
before it in place. There is one writer at a time: a second one that makes the same version fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.functions.ranking import cut_lineage
from pii_spark.operators import vault as vaults
from pii_spark.sources.scratch import delete_path, names_in

#: Buckets of a new store. A write sorts a bucket in one task, so large vaults need more of them.
BUCKETS = 64

VAULT = (
    "id string, original_pii string, dummy_pii string, pii_type string, confidence double, created_at timestamp, "
    "last_accessed_at timestamp, access_count bigint"
)
_ENTRY = "bucket int, folder string, rows bigint, buckets int, batch bigint"


def store_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written as a whole, in order."""
    return [int(n) for n in names_in(spark, f"{path}/versions") if "_SUCCESS" in names_in(spark, f"{path}/versions/{n}")]


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """One entry per bucket with rows, behind one that holds the settings; empty for a new store."""
    known = store_versions(spark, path)
    if not known:
        return []
    rows = spark.read.schema(_ENTRY).json(f"{path}/versions/{(known[-1] if version is None else version):012d}")
    return sorted(rows.collect(), key=lambda r: r["bucket"])


def _bucket(original: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(original), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, entries: list) -> DataFrame:
    paths = [f"{path}/{e['folder']}/bucket={e['bucket']}" for e in entries if e["bucket"] >= 0]
    return spark.read.schema(VAULT).parquet(*paths) if paths else spark.createDataFrame([], VAULT)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the latest version, or of an older one that is still there."""
    return _rows(spark, path, _manifest(spark, path, version))


def _commit(
    spark: SparkSession, path: str, before: list, touched: set[int], made: DataFrame | None, buckets: int, batch: int | None
) -> None:
    """A new version: ``made`` in the buckets ``touched``, all others as they were."""
    entries = [e.asDict() for e in before if e["bucket"] >= 0 and e["bucket"] not in touched]
    number = (store_versions(spark, path) or [-1])[-1] + 1
    if made is not None and touched:
        folder = f"data/{number:012d}-{uuid.uuid4().hex}"
        placed = made.select(vaults.VAULT_COLUMNS).withColumn("bucket", _bucket(F.col("original_pii"), buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        found = spark.read.schema(f"{VAULT}, bucket int").parquet(f"{path}/{folder}").groupBy("bucket").count().collect()
        entries += [{"bucket": r["bucket"], "folder": folder, "rows": r["count"]} for r in found]
    if batch is None and before:
        batch = before[0]["batch"]
    head = {"bucket": -1, "folder": None, "rows": sum(e["rows"] for e in entries), "buckets": buckets, "batch": batch}
    # At most an entry per bucket. A version that exists is an error: another writer was faster.
    rows = [tuple({**dict.fromkeys(("buckets", "batch")), **e}[k] for k in head) for e in [head, *entries]]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("error").json(f"{path}/versions/{number:012d}")


def _settings(before: list, buckets: int = BUCKETS) -> int:
    return before[0]["buckets"] if before else buckets


def _touched(originals: DataFrame, buckets: int) -> set[int]:
    """Buckets of ``originals``; as many numbers as there are buckets at most."""
    return {r["b"] for r in originals.select(_bucket(F.col("original_pii"), buckets).alias("b")).distinct().collect()}


def upsert_store(
    spark: SparkSession, path: str, hits: DataFrame, buckets: int = BUCKETS, batch: int | None = None
) -> None:
    """Take up hits. ``buckets`` counts for a new store only.

    With ``batch``, the number of a micro-batch, hits of a batch that the store holds already do nothing.
    """
    before = _manifest(spark, path)
    if batch is not None and before and before[0]["batch"] is not None and before[0]["batch"] >= batch:
        return
    n = _settings(before, buckets)
    fresh = cut_lineage(vaults.vault_build(hits))
    touched = _touched(fresh, n)
    if not touched:
        return
    old = _rows(spark, path, [e for e in before if e["bucket"] in touched])
    _commit(spark, path, before, touched, vaults.vault_merge(old, fresh), n, batch)


def delete_from_store(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Remove the originals in ``keys(original_pii)``; unknown ones do nothing."""
    before = _manifest(spark, path)
    n = _settings(before)
    keys = cut_lineage(keys.select("original_pii").distinct())
    touched = _touched(keys, n) & {e["bucket"] for e in before}
    if not touched:
        return
    old = _rows(spark, path, [e for e in before if e["bucket"] in touched])
    _commit(spark, path, before, touched, vaults.vault_delete(old, keys), n, None)


def expire_store(spark: SparkSession, path: str, now: Column, max_age: str) -> None:
    """Remove rows created before ``now`` minus the interval; buckets without such rows stay as they are."""
    before = _manifest(spark, path)
    n = _settings(before)
    rows = _rows(spark, path, before)
    touched = _touched(rows.where(F.col("created_at") < now - F.expr(f"interval {max_age}")), n)
    old = _rows(spark, path, [e for e in before if e["bucket"] in touched])
    if touched:
        _commit(spark, path, before, touched, vaults.vault_expire(old, now, max_age), n, None)


def clear_store(spark: SparkSession, path: str) -> None:
    """A version without rows; older versions stay until ``drop_versions``."""
    before = _manifest(spark, path)
    _commit(spark, path, before, {e["bucket"] for e in before}, None, _settings(before), None)


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last ``keep`` versions, and the data that no kept version names.

    Not while a reader of an older version or a writer is at work.
    """
    kept = store_versions(spark, path)[-keep:]
    used = {e["folder"] for v in kept for e in _manifest(spark, path, v) if e["folder"]}
    for name in names_in(spark, f"{path}/versions"):
        if int(name) not in kept:
            delete_path(spark, f"{path}/versions/{name}")
    for name in names_in(spark, f"{path}/data"):
        if f"data/{name}" not in used:
            delete_path(spark, f"{path}/data/{name}")
