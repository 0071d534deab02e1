"""Removal of lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import document_key, written

#: Relative error of the sketches, and how far from the threshold their word is taken.
SKETCH_ERROR, NEAR = 0.13, 2.0

#: Columns that ``remove_spread_lines`` returns anew.
MADE = ("text", "n_lines", "n_removed")


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """``_doc, pos, h1, h2, site`` of each line that is not blank; lines are compared trimmed of spaces.

    Two hashes with different seeds stand for a line: 128 bits.
    """
    exploded = docs.select(
        document_key().alias("_doc"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(_split(F.col("text"))).alias("pos", "_line"),
    )
    line = F.trim("_line")
    return exploded.where(line != "").select(
        "_doc", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "site"
    )


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """The lines (h1, h2) that stand on at least ``min_sites`` distinct sites.

    One HyperLogLog sketch per line counts its sites; sketches merge before and after the shuffle, so
    a line on every page costs one sketch per task. Sketches far from the threshold decide; all
    others get an exact distinct count.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.approx_count_distinct("site", SKETCH_ERROR).alias("_sites"))
    sketched = written(sketched.where(F.col("_sites") >= min_sites / NEAR), "line-spread")
    far = F.col("_sites") > min_sites * NEAR
    exact = (
        lines.join(sketched.where(~far).select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site").agg(F.lit(1).alias("_one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("_exact"))
        .where(F.col("_exact") >= min_sites)
    )
    return sketched.where(far).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def remove_spread_lines(
    docs: DataFrame, site: str = "source", min_sites: int = 8, max_share: float = 0.5
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_removed``.

    A line is boilerplate if it stands, trimmed of spaces, on at least ``min_sites`` distinct values
    of ``site``. Where more than ``max_share`` of the lines of a document that are not blank would
    go, the document is taken for a copy of a widely spread document and stays whole: copies are the
    work of the document-level operators. All other columns pass through.

    Blank lines neither count nor go. A null text has no lines and stays null, a null site counts as
    one site, rows that repeat a ``doc_id`` should repeat its text too. Documents of one line that is
    boilerplate stay whole by the rule above. An empty table gives an empty result.
    """
    lines = written(document_lines(docs, site), "lines")
    hits = (
        lines.join(spread_lines(lines, min_sites), ["h1", "h2"], "left_semi")
        .groupBy("_doc").agg(F.sort_array(F.collect_set("pos")).alias("_hits"))
    )
    # One struct holds the columns of the caller, so that their names cannot clash with those made here.
    whole = docs.select(F.struct(*docs.columns).alias("_row"), document_key().alias("_doc"))
    text, parts = F.col("_row.text"), _split(F.col("_row.text"))
    counted = whole.join(hits, "_doc", "left").select(
        "_row", "_hits",
        F.when(text.isNull(), 0).otherwise(F.size(F.filter(parts, lambda line: F.trim(line) != ""))).alias("_n"),
        F.coalesce(F.size("_hits"), F.lit(0)).alias("_n_hits"),
    )

    def rebuilt(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_hits"))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    # The lines are bound once, as the only element of an array.
    cut = F.get(F.transform(F.array(parts), rebuilt), F.lit(0))
    goes = (F.col("_n_hits") > 0) & (F.col("_n_hits") <= F.col("_n") * max_share)
    made = counted.select(
        "_row",
        F.struct(
            F.when(goes, cut).otherwise(text).alias("text"),
            F.col("_n").alias("n_lines"),
            F.when(goes, F.col("_n_hits")).otherwise(0).alias("n_removed"),
        ).alias("_made"),
    )
    return made.select(*[f"_row.`{c}`" for c in docs.columns if c not in MADE], "_made.*")
