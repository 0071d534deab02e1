"""Writers of datasets, annotation tasks, ledgers, reports and the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.operators.prepare import split_random
from pii_spark.sources.scratch import delete_path


def write_ledger(ledger: DataFrame, path: str) -> None:
    """TSV with header, sorted by file name; tabs and line breaks in issues become blanks."""
    clean = ledger.withColumn("issues", F.translate("issues", "\t\r\n", "   "))
    clean.select("file_name", "status", "issue_count", "issues").orderBy("file_name").write.mode(
        "overwrite"
    ).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_dataset(df: DataFrame, path: str, key: str, ratio: float = 0.1, seed: int = 42) -> None:
    """Parquet in one folder per split, train and test."""
    side = F.when(F.col("split") == "validation", "test").otherwise("train")
    split_random(df, key, ratio, seed).withColumn("split", side).write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def task_name(text: Column, prefix: str = "") -> Column:
    """A name that depends on the text alone, so that reruns write the same names."""
    return F.concat(F.lit(prefix), F.sha2(text, 256), F.lit(".json"))


def write_tasks(tasks: DataFrame, path: str, prefix: str = "") -> None:
    """Annotation tasks as JSON lines, each with its file name in ``data``."""
    named = tasks.withColumn("data", F.struct(
        "data.text", "data.language", "data.country",
        F.coalesce("data.file_name", task_name(F.col("data.text"), prefix)).alias("file_name"),
    ))
    named.write.mode("overwrite").json(path)


def load_tasks_report(tasks: DataFrame) -> DataFrame:
    """One row: tasks that are annotated, predicted, both, neither, and without data."""
    a = F.coalesce(F.size("annotations") > 0, F.lit(False))
    p = F.coalesce(F.size("predictions") > 0, F.lit(False))
    ok = F.col("data").isNotNull()
    return tasks.agg(
        F.count("*").alias("total"),
        F.count_if(~ok).alias("skipped"),
        F.count_if(ok & a).alias("annotated"),
        F.count_if(ok & p).alias("predicted"),
        F.count_if(ok & a & p).alias("both"),
        F.count_if(ok & ~a & ~p).alias("neither"),
    )


def report_row(metrics: DataFrame, **parts: DataFrame) -> DataFrame:
    """One JSON document from a one-row table and small named tables (one row per label, say)."""
    body = [F.col(c) for c in metrics.columns]
    for name, part in parts.items():
        rows = part.agg(F.array_sort(F.collect_list(F.struct(*part.columns)))).scalar()
        body.append(rows.alias(name))
    return metrics.select(F.to_json(F.struct(*body)).alias("value"))


def write_report(metrics: DataFrame, path: str, **parts: DataFrame) -> None:
    report_row(metrics, **parts).write.mode("overwrite").text(path)


def write_log(log: DataFrame, path: str) -> None:
    """Append to the log, one folder per day.

    Rows are dealt by day; adaptive execution splits a busy day over several tasks by the sizes that it
    finds, so the log is computed once.
    """
    days = log.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day")
    days.write.mode("append").partitionBy("day").parquet(path)


def clear_log(spark: SparkSession, path: str) -> None:
    """Delete all days of a written log. What stays is an empty file that keeps the columns."""
    schema = spark.read.parquet(path).drop("day").schema
    delete_path(spark, path)
    spark.createDataFrame([], schema).write.parquet(f"{path}/day=__HIVE_DEFAULT_PARTITION__")
