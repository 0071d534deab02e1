"""Contiguous shards of near equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pii_spark.llm.common import free_name, partitions, written


def text_bytes(text: str = "text", overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead per record."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long")


def shard_by_bytes(sized: DataFrame, n_shards: int, size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    All columns of ``sized`` but ``size`` form the global order, in the order they stand in. The rows
    are dealt to ranges of that order; the totals of the ranges, one row per range, give each range
    the bytes and rows before it, and a running sum inside the range does the rest. The targets cut
    the bytes into equal lengths and a row goes where its middle byte lies, so a shard deviates from
    the target by less than one row at each end. Shards are contiguous in the global order.

    Other columns pass through whatever their names; ``shard`` and ``slot`` are replaced. Nulls sort first. Equal rows are interchangeable and get neighbouring slots. Rows larger than a
    target leave the shards they span empty. An empty table gives an empty result. ``sized`` should
    hold no texts: the rows are written twice, as read and by range.
    """
    spark = sized.sparkSession
    order = [c for c in sized.columns if c != size]
    part, taken, ahead_bytes, ahead_rows, total, place, first_place = (
        free_name(sized, n) for n in ("_range", "_bytes", "_bytes_before", "_rows_before", "_total", "_place", "_first")
    )
    kept = [c for c in sized.columns if c not in ("shard", "slot")]
    # The range exchange samples its input; sampling a small written table spares a second scan of the texts.
    rows = written(sized, "shard-sizes")
    ranged = written(
        rows.repartitionByRange(partitions(spark), *order, size).withColumn(part, F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy(part).agg(F.sum(size).alias(taken), F.count("*").alias("n"))
    # One row per range: as many as shuffle partitions, whatever the number of documents.
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    before = totals.select(
        part,
        F.coalesce(F.sum(taken).over(ahead), F.lit(0)).alias(ahead_bytes),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(ahead_rows),
        F.sum(taken).over(whole).alias(total),
    )
    inside = W.partitionBy(part).orderBy(*order, size).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(size).over(inside) + F.col(ahead_bytes)
    # Integer arithmetic in decimals: bytes times shards can exceed a long.
    middle = (2 * end - F.col(size)).cast("decimal(38,0)")
    shard = F.floor(middle * n_shards / (2 * F.col(total)).cast("decimal(20,0)")).cast("int")
    placed = ranged.join(F.broadcast(before), part).select(
        *kept,
        F.least(shard, F.lit(n_shards - 1)).alias("shard"),
        (F.row_number().over(inside) - 1 + F.col(ahead_rows)).cast("long").alias(place),
    )
    placed = written(placed, "shard-places")
    # At most ``n_shards`` rows.
    first = placed.groupBy("shard").agg(F.min(place).alias(first_place))
    return placed.join(F.broadcast(first), "shard").select(
        *kept, "shard", (F.col(place) - F.col(first_place)).alias("slot")
    )
