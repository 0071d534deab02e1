"""Inputs of the registered queries: driver tables and annotated corpora derived from them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.functions.dummies import hash_draw
from pii_spark.functions.spans import ENTITIES, code_points, entity
from pii_spark.operators.detect import detect_rules
from pii_spark.operators.synth import sample_language_country, synthesize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores where a table has fewer splits than cores, as a one-file table has.

    A large table has many more splits and is left alone. Only for tables as read: the partitions of
    a later step are known by running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id")


def detected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_rules(documents(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document followed by a synthetic annotated sentence, with language and country."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return sample_language_country(synthesize(docs, "doc_id", before="text"), "doc_id")


def second_label(key: Column, e: Column, u: Column) -> Column:
    other = F.when(e["label"] == "COMPANYNAME", "CITY").otherwise("COMPANYNAME")
    return F.when(u == 1, other).when((u == 3) & (key % 5 == 0), "NICKNAME").otherwise(e["label"])


def second_annotation(gold: DataFrame) -> DataFrame:
    """A second annotator: drops, relabels or shortens some entities by hash, and adds a few."""
    key, text = F.col("doc_id"), F.col("text")

    def draw(e: Column) -> Column:
        return hash_draw(F.concat_ws("|", F.lit("p"), key.cast("string"), e["start"].cast("string")), 0) % 10

    def changed(e: Column) -> Column:
        u = draw(e)
        end = e["end"] - F.when((u == 2) & (e["end"] - e["start"] > 1), F.lit(1)).otherwise(F.lit(0))
        return entity(code_points(text, e["start"], end), second_label(key, e, u), e["start"], end, e["confidence"])

    kept = F.transform(F.filter("entities", lambda e: draw(e) != 0), changed).cast(ENTITIES)
    extra = F.array(
        entity(F.substring(text, 1, 4), F.lit("USERNAME"), F.lit(0), F.lit(4), F.lit(0.5))
    ).cast(ENTITIES)
    return gold.withColumn("entities", F.when(key % 7 == 0, F.concat(kept, extra)).otherwise(kept))


def mask_of(entities: str) -> Column:
    return F.transform(
        entities,
        lambda e: F.struct(
            e["text"].alias("value"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")
        ),
    )


def privacy_mask(df: DataFrame) -> DataFrame:
    """``entities`` as the simplified ``privacy_mask``."""
    return df.withColumn("privacy_mask", mask_of("entities")).drop("entities")


def both_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with their own ``gold`` entities and those of the second annotator, in one row."""
    gold = samples(spark, sf_dir)
    return second_annotation(gold.withColumn("gold", F.col("entities")))


def file_name(key: Column) -> Column:
    return F.concat(F.lit("doc_"), key.cast("string"), F.lit(".json"))
