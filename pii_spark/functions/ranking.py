"""Exact selections over a whole table that never sort it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pii_spark.sources.scratch import shared_folder


def running_counts(counts: DataFrame, by: list[str], order: list[str], count: str) -> DataFrame:
    """Add ``_upto``, the running total of ``count`` by ``order``, and ``_total``, both per ``by``.

    Rows are dealt to ranges of (by, order). The totals of the ranges, a row for each range and group,
    give every range what comes ahead of it, so no window runs over more than the rows of a range or
    the ranges of a group.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        counts.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_range").agg(F.sum(count).alias("_sum"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ahead = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"), F.sum("_sum").over(group).alias("_total")
    )
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.withColumn("_own", F.sum(count).over(inside)).join(starts, [*by, "_range"])
        .withColumn("_upto", F.col("_own") + F.col("_start")).drop("_own", "_start", "_range")
    )


def mark_smallest(
    df: DataFrame,
    hashed: Column,
    wanted: Callable[[Column], Column],
    tie: str,
    by: list[str] | None = None,
    first: Column | None = None,
    flag: str = "chosen",
) -> DataFrame:
    """Flag, per ``by``, the ``wanted(total)`` rows that come first in (``first``, ``hashed``).

    ``hashed`` is a hex string that spreads rows evenly and ``tie`` is unique per row. Rows are counted per cell of (by, first,
    hash prefix); running totals over the cells tell which cells are in or out as a whole. Only the
    cells that hold a cut are ranked row by row, so no group is ever sorted in one task.
    """
    by = by or []
    digits = 2 if by or first is not None else 4
    cell = [*by, "_f", "_b"]
    keyed = (
        df.withColumn("_h", hashed)
        .withColumn("_b", F.substring("_h", 1, digits))
        .withColumn("_f", F.lit(0) if first is None else first)
    )
    counts = keyed.groupBy(*cell).agg(F.count("*").alias("_c"))
    if by or first is not None:
        counts = running_counts(counts, by, ["_f", "_b"], "_c")
    else:
        # At most 65 536 cells.
        whole = W.partitionBy()
        running = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_c").over(running)).withColumn("_total", F.sum("_c").over(whole))
    cut = counts.withColumn("_k", wanted(F.col("_total"))).select(
        *cell, (F.col("_upto") - F.col("_c")).alias("_before"), "_upto", "_k"
    )
    placed = keyed.join(cut if by or first is not None else F.broadcast(cut), cell)
    split = (F.col("_before") < F.col("_k")) & (F.col("_upto") > F.col("_k"))
    whole = placed.where(~split).withColumn(flag, F.col("_upto") <= F.col("_k"))
    ranked = placed.where(split).withColumn(
        flag,
        F.row_number().over(W.partitionBy(*cell).orderBy("_h", tie)) + F.col("_before") <= F.col("_k"),
    )
    return whole.unionByName(ranked).drop("_h", "_b", "_f", "_before", "_upto", "_k")


_CELLS = 4096


def exact_percentiles(
    df: DataFrame, value: str, fractions: list[float], by: list[str] | None = None
) -> DataFrame:
    """Interpolated percentiles per group: columns ``by``, ``fraction``, ``percentile``.

    ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here
    ``percentile_approx`` brackets each wanted rank, the rows below a bracket are counted, and of the
    distinct values inside a bracket only those around the rank are ordered.
    """
    if not by:
        whole = exact_percentiles(df.withColumn("_all", F.lit(0)), value, fractions, ["_all"])
        return whole.drop("_all")
    accuracy = 10_000
    slack = 4.0 / accuracy
    points = [p for f in fractions for p in (max(f - slack, 0.0), min(f + slack, 1.0))]
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sketch = data.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", points, accuracy).alias("_q"),
    )
    # Below this size a bracket may span less than one rank, and the group is small anyway.
    small = F.col("_n") <= accuracy
    brackets = sketch.select(
        *by,
        "_n",
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(f).alias("fraction"),
                    F.when(small | F.lit(f - slack <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("_lo"),
                    F.when(small | F.lit(f + slack >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("_hi"),
                )
                for i, f in enumerate(fractions)
            ])
        ).alias("_b"),
    ).select(*by, "_n", "_b.*").withColumn("_rank", F.col("fraction") * (F.col("_n") - 1))
    values = data.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    joined = values.join(brackets, by)
    below = joined.groupBy(*by, "fraction").agg(
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("_lo"), F.col("_c"))), F.lit(0)).alias("_below")
    )
    # Order cells of the bracket first, then only the values of the cells that hold a wanted rank.
    group = [*by, "fraction"]
    width = F.col("_hi") - F.col("_lo")
    cell = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * _CELLS)).otherwise(0)
    inside = joined.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn("_cell", cell)
    cells = inside.groupBy(*group, "_cell", "_rank").agg(F.sum("_c").alias("_cc")).join(below, group)
    cells_so_far = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    hit = (
        cells.withColumn("_end", F.sum("_cc").over(cells_so_far) + F.col("_below"))
        .withColumn("_start", F.col("_end") - F.col("_cc"))
        .where((F.col("_start") <= F.ceil("_rank")) & (F.col("_end") > F.floor("_rank")))
        .select(*group, "_cell", "_start")
    )
    running = W.partitionBy(*group, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        inside.join(hit, [*group, "_cell"])
        .withColumn("_last", F.sum("_c").over(running) + F.col("_start") - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
    )
    low, high = F.floor("_rank"), F.ceil("_rank")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (F.col("_last") >= rank), F.col("_v")))

    found = placed.groupBy(*by, "fraction").agg(
        at(low).alias("_a"), at(high).alias("_z"), F.max(F.col("_rank") - low).alias("_w")
    )
    return found.select(
        *by, "fraction", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")).alias("percentile")
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
