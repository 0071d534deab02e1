"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import written


def _down(links: DataFrame) -> DataFrame:
    """Links as (u, v) with u > v, each once."""
    pair = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pair.distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of the ends of ``links`` (u, v): the smallest id that links reach.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Minima combine before the shuffle, the joins that hand them
    out have one row per node on one side, and every round is written, so hubs and long chains cost
    no more than their links. Smallest nodes have no row. Only counts come to the driver.
    """
    links, state = written(_down(links), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("l")
        ).select("l.*")
        links = written(handed.where("u <> v").distinct(), "links")
        hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(links.agg(F.count("*"), hashed).first())
        if now == state:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
