"""Statistics of annotated samples.

Input records have ``text, language, country, labels, all_labels, entities(label, value),
entity_count, coref_cluster_count, has_coreferences`` as made by the normalisers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv


def share(part: Column, whole: Column) -> Column:
    """Percentage; 0 for an empty whole."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def dataset_profile(records: DataFrame) -> DataFrame:
    """One row: sample, entity, text-length and coreference figures.

    The median comes from the lengths' histogram: a buffer of distinct lengths, not of samples.
    """
    length = F.length("text")
    hist = records.groupBy(length.alias("len")).agg(
        F.count("*").alias("n"),
        F.sum("entity_count").alias("entities"),
        F.min("entity_count").alias("lo"),
        F.max("entity_count").alias("hi"),
        F.count_if(F.col("entity_count") == 0).alias("bare"),
        F.sum("coref_cluster_count").alias("clusters"),
        F.count_if("has_coreferences").alias("with_coref"),
    )
    total = F.sum("n")
    return hist.agg(
        F.coalesce(total, F.lit(0)).alias("total_samples"),
        F.coalesce(F.sum("bare"), F.lit(0)).alias("unannotated"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entity_total"),
        F.round(F.coalesce(F.sum("entities") / total, F.lit(0.0)), 4).alias("entity_avg"),
        F.coalesce(F.min("lo"), F.lit(0)).alias("entity_min"),
        F.coalesce(F.max("hi"), F.lit(0)).alias("entity_max"),
        F.coalesce(F.min("len"), F.lit(0)).alias("text_len_min"),
        F.coalesce(F.max("len"), F.lit(0)).alias("text_len_max"),
        F.round(F.coalesce(F.sum(F.col("len") * F.col("n")) / total, F.lit(0.0)), 4).alias("text_len_avg"),
        F.coalesce(F.percentile("len", F.lit(0.5), F.col("n")), F.lit(0.0)).alias("text_len_median"),
        F.coalesce(F.sum("clusters"), F.lit(0)).alias("total_coref_clusters"),
        F.coalesce(F.sum("with_coref"), F.lit(0)).alias("samples_with_coref"),
        F.round(F.coalesce(share(F.sum("with_coref"), total), F.lit(0.0)), 4).alias("coref_pct"),
    )


def _with_share(counts: DataFrame, total: DataFrame) -> DataFrame:
    return counts.withColumn("pct", F.round(share(F.col("n"), total.scalar()), 4))


def distribution(records: DataFrame, column: str) -> DataFrame:
    """Samples per value of ``language`` or ``country``, with their percentage."""
    counts = records.groupBy(column).agg(F.count("*").alias("n"))
    return _with_share(counts, records.agg(F.count("*")))


def _exploded(records: DataFrame, column: str, name: str) -> DataFrame:
    """One row per element; the outer form keeps the array from being computed twice."""
    return records.select(F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def label_distribution(records: DataFrame) -> DataFrame:
    """Entities per standard label, with the percentage of all entities."""
    counts = _exploded(records, "labels", "label").groupBy("label").agg(
        F.count("*").alias("n")
    )
    return _with_share(counts, records.agg(F.sum("entity_count")))


def non_standard_labels(records: DataFrame, labels_dim: DataFrame) -> DataFrame:
    """Counts of labels outside the standard set; labels are counted before the anti join."""
    counts = _exploded(records, "all_labels", "label").groupBy("label").agg(
        F.count("*").alias("n")
    )
    return counts.join(labels_dim.select("label"), "label", "left_anti")


def label_pairs(records: DataFrame, top: int | None = 10) -> DataFrame:
    """How often two distinct labels meet in one sample; at most 26 labels, so 325 pairs, a row."""
    labels = F.array_sort(F.array_distinct("labels"))
    pairs = F.flatten(
        F.transform(
            "ls",
            lambda a, i: F.transform(
                F.slice("ls", i + 2, F.size("ls")),
                lambda b: F.struct(a.alias("label_a"), b.alias("label_b")),
            ),
        )
    )
    counts = (
        records.select(labels.alias("ls"))
        .select(F.explode_outer(pairs).alias("p"))
        .where(F.col("p").isNotNull())
        .groupBy("p.label_a", "p.label_b")
        .agg(F.count("*").alias("n"))
    )
    return counts if top is None else counts.orderBy(F.desc("n"), "label_a", "label_b").limit(top)


def _values(records: DataFrame) -> DataFrame:
    return (
        _exploded(records, "entities", "e")
        .groupBy(F.col("e.label").alias("label"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def value_diversity(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values per label; the approximate form shuffles sketches instead of values."""
    if approximate:
        return _exploded(records, "entities", "e").groupBy(
            F.col("e.label").alias("label")
        ).agg(
            F.approx_count_distinct("e.value").alias("distinct_values"), F.count("*").alias("n")
        )
    return _values(records).groupBy("label").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("n")
    )


def top_values(records: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per label.

    Counted first; the rank filter becomes a per-task group limit ahead of the shuffle on label.
    """
    w = W.partitionBy("label").orderBy(F.desc("n"), "value")
    return _values(records).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def card_countries(records: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` countries and one remainder row ``(n more)``, with percentages."""
    counts = records.groupBy("country").agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), "country").limit(top)
    rest = counts.join(head.select("country"), "country", "left_anti").agg(
        F.concat(F.lit("("), F.count("*").cast("string"), F.lit(" more)")).alias("country"),
        F.sum("n").alias("n"),
    ).where(F.col("n").isNotNull())
    return _with_share(head.unionByName(rest), records.agg(F.count("*")))


def labels_dimension(spark) -> DataFrame:
    """The 26 labels with order, weight, address flag and BIO ids."""
    rows = [
        (label, i, fv.LABEL_CHANCE.get(label, fv.DEFAULT_CHANCE), label in fv.ADDRESS_LABELS,
         2 * i + 1, 2 * i + 2)
        for i, label in enumerate(fv.STANDARD_LABELS)
    ]
    return spark.createDataFrame(
        rows, "label string, ord int, chance double, is_address boolean, b_id int, i_id int"
    )
