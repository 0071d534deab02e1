"""The mapping table original <-> dummy. Every function returns the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.dummies import generate_dummy
from pii_spark.functions.offsets import let_sql
from pii_spark.functions.ranking import cut_lineage, mark_smallest
from pii_spark.functions.spans import first_by_key_sql

VAULT_COLUMNS = [
    "id", "original_pii", "dummy_pii", "pii_type", "confidence", "created_at",
    "last_accessed_at", "access_count",
]


def vault_id(original: Column) -> Column:
    """A stable key in place of a counter, which would need one writer: the whole digest of the original."""
    return F.md5(original)


def hits_from_entities(entities: DataFrame, at: Column) -> DataFrame:
    """Hits (original_pii, dummy_pii, pii_type, confidence, ts) from exploded entities."""
    return entities.select(
        F.col("text").alias("original_pii"), F.col("dummy").alias("dummy_pii"),
        F.col("label").alias("pii_type"), "confidence", at.alias("ts"),
    )


def _grouped(hits: DataFrame) -> DataFrame:
    """One row per original; map-side combined, so a hot original is no hot task."""
    first = F.struct("ts", "pii_type", "dummy_pii")
    last = F.struct("ts", "confidence")
    return hits.groupBy("original_pii").agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("hits")
    )


def vault_build(hits: DataFrame) -> DataFrame:
    """A new vault from hits."""
    return _grouped(hits).select(
        vault_id(F.col("original_pii")).alias("id"),
        "original_pii",
        F.col("first.dummy_pii").alias("dummy_pii"),
        F.col("first.pii_type").alias("pii_type"),
        F.col("last.confidence").alias("confidence"),
        F.col("first.ts").alias("created_at"),
        F.col("last.ts").alias("last_accessed_at"),
        F.col("hits").alias("access_count"),
    )


def vault_upsert(vault: DataFrame, hits: DataFrame) -> DataFrame:
    """New originals are added with their hits; known ones keep dummy and type, count the hits and
    take the latest confidence and access time."""
    return vault_merge(vault, vault_build(hits))


def vault_merge(vault: DataFrame, fresh: DataFrame) -> DataFrame:
    """``vault_upsert`` with hits that ``vault_build`` has grouped."""
    v, new = vault.alias("v"), fresh.alias("n")
    known = F.col("v.original_pii").isNotNull()
    return v.join(new, F.col("v.original_pii") == F.col("n.original_pii"), "full_outer").select(
        F.coalesce("v.id", "n.id").alias("id"),
        F.coalesce("v.original_pii", "n.original_pii").alias("original_pii"),
        F.coalesce("v.dummy_pii", "n.dummy_pii").alias("dummy_pii"),
        F.when(known, F.col("v.pii_type")).otherwise(F.col("n.pii_type")).alias("pii_type"),
        F.coalesce("n.confidence", "v.confidence").alias("confidence"),
        F.coalesce("v.created_at", "n.created_at").alias("created_at"),
        F.greatest("n.last_accessed_at", "v.last_accessed_at").alias("last_accessed_at"),
        (F.coalesce("v.access_count", F.lit(0)) + F.coalesce("n.access_count", F.lit(0))).alias(
            "access_count"
        ),
    )


def vault_lookup(keys: DataFrame, vault: DataFrame, direction: str = "to_dummy") -> DataFrame:
    """Add ``found`` to ``keys(key)``: the dummy of an original, or the original of a dummy.

    The join strategy is left to the optimizer: sizes are known at run time only, and a hot key
    meets a single vault row.
    """
    source, target = {
        "to_dummy": ("original_pii", "dummy_pii"), "to_original": ("dummy_pii", "original_pii"),
    }[direction]
    side = vault.select(F.col(source).alias("key"), F.col(target).alias("found"))
    return keys.join(side, "key", "left")


def vault_touch(vault: DataFrame, originals: DataFrame, at: Column) -> DataFrame:
    """Count lookups: ``originals(original_pii)`` holds one row per lookup."""
    used = originals.groupBy("original_pii").agg(F.count("*").alias("_n"))
    hit = F.col("_n").isNotNull()
    return vault.join(used, "original_pii", "left").select(
        "id", "original_pii", "dummy_pii", "pii_type", "confidence", "created_at",
        F.when(hit, F.greatest(at, F.col("last_accessed_at"))).otherwise(F.col("last_accessed_at"))
        .alias("last_accessed_at"),
        (F.col("access_count") + F.coalesce("_n", F.lit(0))).alias("access_count"),
    )


def vault_delete(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the originals in ``keys(original_pii)``; unknown keys do nothing."""
    return vault.join(keys.select("original_pii").distinct(), "original_pii", "left_anti").select(
        VAULT_COLUMNS
    )


def vault_expire(vault: DataFrame, now: Column, max_age: str) -> DataFrame:
    """Without the rows created before ``now`` minus the interval, e.g. ``1 hour``."""
    return vault.where(F.col("created_at") >= now - F.expr(f"interval {max_age}"))


def vault_expired_count(vault: DataFrame, now: Column, max_age: str) -> DataFrame:
    return vault.agg(
        F.count_if(F.col("created_at") < now - F.expr(f"interval {max_age}")).alias("removed"),
        F.count("*").alias("total"),
    )


def vault_count(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("rows"))


def vault_collisions(vault: DataFrame) -> DataFrame:
    """Dummies that stand for several originals, with the number of them."""
    return vault.groupBy("dummy_pii").agg(
        F.count("*").alias("originals"), F.min("original_pii").alias("first_original")
    ).where(F.col("originals") > 1)


def vault_resolve(vault: DataFrame, salt: str = "", rounds: int = 3) -> DataFrame:
    """Draw new dummies for originals that share one, ``rounds`` times, then number the rest.

    Per dummy the longest-kept original wins: one aggregation finds the winners, and the join back
    is on the unique original, so a dummy shared by very many originals stays spread out. The pools of
    values are finite, so draws alone do not end collisions: a dummy that is still shared after the last
    round gets the digest of its original as a suffix, which makes both columns unique; ``suffixed``
    tells. Every round is checkpointed, since it reads its input twice.
    """
    current = vault.withColumn("attempt", F.lit(0))
    for step in range(rounds + 1):
        winners = current.groupBy("dummy_pii").agg(
            F.min(F.struct("attempt", "original_pii")).alias("w")
        ).select(F.col("w.original_pii").alias("original_pii"), F.lit(True).alias("_won"))
        current = current.join(winners, "original_pii", "left")
        lost = F.col("_won").isNull()
        if step == rounds:
            unique = F.concat_ws("-", "dummy_pii", vault_id(F.col("original_pii")))
            current = current.withColumn("suffixed", lost).withColumn(
                "dummy_pii", F.when(lost, unique).otherwise(F.col("dummy_pii"))
            )
        else:
            current = current.withColumn(
                "attempt", F.when(lost, F.lit(step + 1)).otherwise(F.col("attempt"))
            ).withColumn(
                "dummy_pii",
                F.when(
                    lost, generate_dummy(F.col("pii_type"), F.col("original_pii"), salt, F.col("attempt"))
                ).otherwise(F.col("dummy_pii")),
            )
        current = current.drop("_won")
        if step < rounds:
            current = cut_lineage(current)
    return current.select(*VAULT_COLUMNS, "attempt", "suffixed")


def document_maps(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both directions as maps per document; bounded by the entities of one text.

    Of several dummies of one text, and of several texts of one dummy, the smallest stays.
    """
    pairs = F.array_sort(F.collect_set(F.struct("text", "dummy")))
    per_doc = entities.groupBy(key).agg(pairs.alias("p"))

    def to_map(source: str, target: str) -> Column:
        entries = first_by_key_sql(f"transform(x, p -> named_struct('key', p.{source}, 'value', p.{target}))")
        return let_sql(F.col("p"), f"map_from_entries({entries})")

    return per_doc.select(
        key, to_map("text", "dummy").alias("to_dummy"), to_map("dummy", "text").alias("to_original")
    )


def vault_trim(vault: DataFrame, max_rows: int = fv.MAX_VAULT_ROWS) -> DataFrame:
    """The ``max_rows`` most recently used rows, ties by original; however many, no task sorts them all."""
    marked = mark_smallest(
        vault, F.hex("original_pii"), lambda total: F.least(F.lit(max_rows), total), "original_pii",
        first=-F.unix_micros("last_accessed_at"),
    )
    return marked.where("chosen").drop("chosen")
