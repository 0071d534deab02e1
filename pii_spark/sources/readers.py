"""Readers of annotated samples, evaluation sets, batch results and ledgers. All use fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.functions.ranking import mark_smallest
from pii_spark.operators import batches, normalize

SAMPLE = (
    f"text string, privacy_mask {normalize.MASK}, "
    "coreferences array<struct<cluster_id:int,entity_type:string,mentions:variant>>, "
    f"language string, country string, {normalize.TASK}, _corrupt_record string"
)
GOLD = "id string, text string, entities array<struct<start:int,end:int,label:string,text:string>>"
LEDGER = "file_name string, status string, issue_count int, issues string"


def detect_format() -> Column:
    """Per row: task, simplified, or the reason why it is neither."""
    data = F.col("data").isNotNull()
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "bad_json")
        .when(data & F.col("predictions").isNotNull(), "task")
        .when(F.col("text").isNotNull() & F.col("privacy_mask").isNotNull(), "simplified")
        .when(data, "task")
        .otherwise("unknown")
    )


def read_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples with ``file_name`` and ``format``; unreadable files stay as rows with a bad format.

    One JSON document per file, or per line with ``lines``; the latter splits and suits large sets.
    """
    raw = (
        spark.read.schema(SAMPLE).option("multiLine", not lines).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )
    return raw.withColumn("file_name", F.col("_metadata.file_name")).withColumn("format", detect_format())


def sample_records(samples: DataFrame) -> DataFrame:
    """Profile records of samples of both formats; other rows go."""
    simple = samples.where(F.col("format") == "simplified").select(
        "file_name", "text", "privacy_mask", "coreferences", "language", "country"
    )
    tasks = samples.where(F.col("format") == "task").select(
        "file_name", "data", "predictions", "annotations"
    )
    return normalize.normalize_simplified(simple).unionByName(normalize.normalize_task(tasks))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Gold samples, one JSON object per line; blank lines are skipped."""
    rows = spark.read.schema(GOLD).json(path).where(F.col("id").isNotNull() | F.col("text").isNotNull())
    return rows if limit is None else rows.limit(limit)


def read_foreign(
    spark: SparkSession, path: str, language: str | None = None, n: int = 0, seed: int = 42,
    key: str = "source_text",
) -> DataFrame:
    """Foreign rows, by language in any case, and ``n`` of them by hash order of ``key`` (all for 0).

    Rows of one key are ordered by a hash of all their columns, so only equal rows are interchangeable.
    """
    rows = spark.read.parquet(path)
    if language is not None:
        rows = rows.where(F.lower("language") == language.lower())
    if n <= 0:
        return rows
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    tied = rows.withColumn("_tie", F.xxhash64(*[F.to_json(F.struct("*"))]))
    drawn = mark_smallest(tied, order, lambda total: F.least(F.lit(n), total), "_tie")
    return drawn.where("chosen").drop("chosen", "_tie")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines with their status; rejected lines carry the reason."""
    return batches.parse_lines(spark.read.text(path))


def quarantine(parsed_lines: DataFrame) -> DataFrame:
    return parsed_lines.where(F.col("status") != "ok").select("status", "custom_id", "value")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
