"""Replacing personal data by dummies and back, over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions.exact import assigned_sql, brackets_sql, first_draws_sql, originals_sql, redrawn_sql
from pii_spark.functions.offsets import bind, compute_once, let, let_sql
from pii_spark.functions.spans import (
    average_confidence,
    covered_characters,
    dummies_sql,
    longest_first,
    mapping_sql,
    replaced_sql,
    restore_by_span,
    restore_text,
)
from pii_spark.operators.detect import RULES, detected_sql


def masked_sql(text: str, entities: str, salt: str = "") -> str:
    found = (
        f"named_struct('masked_text', {replaced_sql(text, 'spans')}, "
        f"'masked_to_original', {mapping_sql('spans')}, 'entities', spans)"
    )
    return bind(dummies_sql(f"filter({entities}, e -> e.text <> '')", salt), "spans", found)


def masked(text: Column, entities: Column, salt: str = "") -> Column:
    """STRUCT<masked_text, masked_to_original, entities>; the entities carry their dummy."""
    both = F.struct(text.alias("t"), entities.alias("e"))
    return let_sql(both, masked_sql("x.t", "x.e", salt))


def mask_text(df: DataFrame, text: str = "text", entities: str = "entities", salt: str = "") -> DataFrame:
    """Add ``masked_text`` and ``masked_to_original``; entities gain ``dummy``. Row-local."""
    out = compute_once(df, "_m", masked(F.col(text), F.col(entities), salt))
    return (
        out.withColumn("masked_text", F.col("_m.masked_text"))
        .withColumn("masked_to_original", F.col("_m.masked_to_original"))
        .withColumn(entities, F.col("_m.entities"))
        .drop("_m")
    )


def mask_exact(df: DataFrame, text: str = "text", entities: str = "entities", salt: str = "") -> DataFrame:
    """Like ``mask_text``, with dummies that ``restore_text`` leads back to the very text.

    Inside a row, different originals get different dummies, and no dummy stands in the text itself:
    clashing draws are repeated, and what still clashes, as labels without a generator do, gets a
    numbered placeholder. Where a dummy would arise between a dummy and the text beside it, all of the
    row become placeholders. Rows without a clash get the dummies of ``mask_text``. Row-local.
    """
    out = df.withColumn("_spans", F.filter(entities, lambda e: e["text"] != ""))
    out = compute_once(out, "_groups", F.expr(originals_sql("_spans")))
    out = compute_once(out, "_entries", F.expr(first_draws_sql("_groups", salt)))
    out = compute_once(out, "_entries", F.expr(redrawn_sql("_entries", f"`{text}`", salt)))

    def masked_with(all_numbered: str) -> Column:
        spans = assigned_sql("_groups", "_entries", brackets_sql(f"`{text}`"), all_numbered)
        return let_sql(
            F.struct(F.col(text).alias("t"), F.expr(spans).alias("s")),
            f"named_struct('masked_text', {replaced_sql('x.t', 'x.s')}, 'masked_to_original', {mapping_sql('x.s')}, 'entities', x.s)",
        )

    out = compute_once(out, "_m", masked_with("false"))
    out = compute_once(
        out, "_plain", (F.size("_spans") > 0) & (restore_text(F.col("_m.masked_text"), F.col("_m.masked_to_original")) != F.col(text))
    )
    out = compute_once(out, "_m", F.when(F.col("_plain"), masked_with("true")).otherwise(F.col("_m")))
    return (
        out.withColumn("masked_text", F.col("_m.masked_text"))
        .withColumn("masked_to_original", F.col("_m.masked_to_original"))
        .withColumn(entities, F.col("_m.entities"))
        .drop("_groups", "_entries", "_spans", "_plain", "_m")
    )


def detect_and_mask(text: Column, rules=RULES, salt: str = "") -> Column:
    """Rule detection and masking of one text as a single expression."""
    found = bind(detected_sql("x", tuple(rules)), "entities", masked_sql("x", "entities", salt))
    return let_sql(text, found)


def restore(df: DataFrame, text: str = "answer", mapping: str = "masked_to_original") -> DataFrame:
    return df.withColumn("restored_text", restore_text(F.col(text), F.col(mapping)))


def restore_exact(df: DataFrame, text: str = "masked_text", entities: str = "entities") -> DataFrame:
    return df.withColumn("restored_text", restore_by_span(F.col(text), F.col(entities)))


def pii_check(df: DataFrame, text: str = "text") -> DataFrame:
    """The check record of every text: masked message, map, detected entities, found flag."""
    m = compute_once(df, "_m", detect_and_mask(F.col(text)))
    found = F.size("_m.entities") > 0
    return m.select(
        *[c for c in df.columns if c != text],
        F.col("_m.masked_text").alias("masked_message"),
        F.col("_m.masked_to_original").alias("entities"),
        F.transform(
            "_m.entities",
            lambda e: F.struct(
                e["label"].alias("label"), e["text"].alias("original"), e["start"].alias("start"),
                e["end"].alias("end"), e["confidence"].alias("confidence"),
            ),
        ).alias("detected_entities"),
        found.alias("pii_found"),
    )


def pii_details(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per text the entities longer than two characters with their masked form.

    Needs ``entities`` (with dummy) and ``masked_to_original``. The masked form is looked up in the
    map. With ``max_bytes``, details that exceed it as JSON are null as a whole.
    """
    entries = longest_first(F.col("masked_to_original"))
    details = let(
        entries,
        lambda pairs: F.transform(
            F.filter("entities", lambda e: F.length(e["text"]) > 2),
            lambda e: F.struct(
                e["text"].alias("text"),
                F.coalesce(
                    F.get(F.filter(pairs, lambda p: p["value"] == e["text"]), F.lit(0))["key"],
                    F.lit(""),
                ).alias("masked_text"),
                e["label"].alias("label"),
                e["confidence"].alias("confidence"),
                e["start"].alias("start_pos"),
                e["end"].alias("end_pos"),
            ),
        ),
    )
    if max_bytes is not None:
        details = let(details, lambda d: F.when(F.octet_length(F.to_json(d)) <= max_bytes, d))
    return df.withColumn("pii_details", details)


def entities_in_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Keep the entities whose dummy occurs in the masked response."""
    return df.withColumn(
        "used_entities",
        F.filter("entities", lambda e: (e["dummy"] != "") & F.contains(F.col(response), e["dummy"])),
    )


def add_average_confidence(df: DataFrame, entities: str = "entities") -> DataFrame:
    return df.withColumn("average_confidence", average_confidence(F.col(entities)))


def pii_coverage(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Add ``covered`` characters and their ``share``; every occurrence of a value counts."""
    values = F.transform(entities, lambda e: e["text"])
    covered = F.when(
        F.size(entities) > 0, covered_characters(F.col(text), values)
    ).otherwise(F.lit(0))
    return df.withColumn("covered", covered).withColumn(
        "share",
        F.when(F.length(text) > 0, F.col("covered") / F.length(text)).otherwise(F.lit(0.0)),
    )


def conversation_vault(turns: DataFrame, entities: str = "entities") -> DataFrame:
    """Distinct (conv_id, original, label, dummy) of all turns, in exploded form.

    A conversation may hold a large part of all turns, so its map is never gathered in one row.
    """
    return (
        turns.select("conv_id", F.explode_outer(entities).alias("e"))
        .where(F.col("e").isNotNull())
        .select("conv_id", F.col("e.text").alias("original"), F.col("e.label").alias("label"),
                F.col("e.dummy").alias("dummy"))
        .distinct()
    )


def mask_conversations(turns: DataFrame, text: str = "text", salt: str = "") -> DataFrame:
    """Mask every turn; equal originals get equal dummies, so all turns share one mapping.

    The dummy is a keyed hash of the original, not a per-request draw: turns agree without joining
    them to a conversation-wide map, and the work stays row-local.
    """
    m = compute_once(turns, "_m", detect_and_mask(F.col(text), salt=salt))
    return m.select(
        "conv_id", "turn", "role", F.col("_m.masked_text").alias("masked_text"),
        F.col("_m.masked_to_original").alias("masked_to_original"),
        F.col("_m.entities").alias("entities"),
    )
