"""Requests to and results from batch annotation jobs, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions.offsets import bind, compute_once, let_sql, text_literal
from pii_spark.operators.payloads import field_sql, list_sql, object_sql

FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"


def fix_unicode_escapes(text: Column) -> Column:
    r"""``\u0000XX`` escapes become ``\u00XX``."""
    return F.regexp_replace(text, r"\\u0000([0-9a-fA-F]{2})", r"\\u00$1")


def extract_json_block(content: Column) -> Column:
    """ARRAY<VARIANT> of samples: the first fenced block, else the whole content.

    A single object becomes a list of one; null for anything that is neither object nor list.
    """
    fence = text_literal(FENCE)
    block = f"CASE WHEN x RLIKE {fence} THEN regexp_extract(x, {fence}, 1) ELSE x END"
    return let_sql(content, bind(f"try_parse_json(trim({block}))", "j", _samples_sql("j")))


def _samples_sql(v: str) -> str:
    return (
        f"CASE WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN {list_sql(v, '$')} "
        f"WHEN {object_sql(v)} IS NOT NULL THEN array({v}) END"
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Result lines with ``status`` ok or the reason of the reject, custom_id and samples.

    Rejects stay in the table so that they can be written to a quarantine.
    """
    block = "CASE WHEN content RLIKE {f} THEN regexp_extract(content, {f}, 1) ELSE content END"
    samples = bind(
        f"try_parse_json(trim({block.format(f=text_literal(FENCE))}))", "b", _samples_sql("b")
    )
    status = (
        "CASE WHEN j IS NULL THEN 'bad_json' "
        "WHEN coalesce(try_variant_get(j, '$.response.status_code', 'int'), 200) <> 200 THEN 'bad_status' "
        "WHEN coalesce(size(choices), 0) <= 0 THEN 'no_choices' "
        "WHEN coalesce(content, '') = '' THEN 'no_content' "
        "WHEN samples IS NULL THEN 'bad_content' ELSE 'ok' END"
    )
    custom = (
        "coalesce(try_variant_get(j, '$.custom_id', 'string'), try_variant_get(j, '$.customID', 'string'), 'unknown')"
    )
    result = (
        f"named_struct('status', {status}, 'custom_id', {custom}, 'samples', samples, "
        "'metadata', try_variant_get(j, '$.response.body.metadata', 'variant'))"
    )
    choices = (
        "CASE WHEN try_variant_get(j, '$.response', 'variant') IS NOT NULL "
        f"THEN {list_sql('j', '$.response.body.choices')} ELSE {list_sql('j', '$.body.choices')} END"
    )
    body = bind(
        "try_parse_json(x)", "j",
        bind(
            choices, "choices",
            bind(field_sql("get(choices, 0)", "$.message.content"), "content", bind(samples, "samples", result)),
        ),
    )
    rows = compute_once(lines.where(F.trim(column) != ""), "_p", let_sql(F.col(column), body))
    return rows.select(*lines.columns, "_p.*")


def explode_samples(parsed_lines: DataFrame, file_id: str) -> DataFrame:
    """One row per sample: custom_id, file_name, sample VARIANT.

    The file name gets a running suffix only where a line holds several samples.
    """
    rows = parsed_lines.select(
        "custom_id", "status", F.size("samples").alias("n"), F.posexplode_outer("samples").alias("ix", "sample")
    ).where((F.col("status") == "ok") & F.col("ix").isNotNull())
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("ix").cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.lit(file_id + "-"), F.col("custom_id"), suffix, F.lit(".json"))
    return rows.select("custom_id", name.alias("file_name"), "sample")


def parse_ner_results(parsed_lines: DataFrame) -> DataFrame:
    """First sample per line with language, country and index from the metadata."""
    meta = F.col("metadata")
    return parsed_lines.where(F.col("status") == "ok").select(
        "custom_id",
        F.get("samples", F.lit(0)).alias("ner_sample"),
        F.coalesce(F.try_variant_get(meta, "$.language", "string"), F.lit("English")).alias("language"),
        F.coalesce(F.try_variant_get(meta, "$.country", "string"), F.lit("United States")).alias("country"),
        F.coalesce(F.try_variant_get(meta, "$.sample_index", "bigint"), F.lit(0)).alias("sample_index"),
    )


def parse_for_review(parsed_lines: DataFrame) -> DataFrame:
    """Every sample of every line, with its own language and country or the defaults."""
    rows = explode_samples(parsed_lines, "review")
    s = F.col("sample")
    return rows.select(
        "custom_id", "sample",
        F.coalesce(F.try_variant_get(s, "$.language", "string"), F.lit("English")).alias("language"),
        F.coalesce(F.try_variant_get(s, "$.country", "string"), F.lit("United States")).alias("country"),
    )


_PREFIX = {"ner": "ner-request-", "coref": "coref-", "review": "review-"}


def build_batch_requests(
    df: DataFrame, kind: str, id_column: str, prompt: Column, model: str, temperature: Column,
    metadata: list[str],
) -> DataFrame:
    """Request lines (custom_id, value) for one stage. Later stages prefix the id of the stage
    before, and carry its metadata forward."""
    custom = F.concat(F.lit(_PREFIX[kind]), F.col(id_column).cast("string"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
        temperature.alias("temperature"),
        F.struct(*[F.col(m) for m in metadata]).alias("metadata"),
    )
    request = F.struct(
        custom.alias("custom_id"), F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"), body.alias("body"),
    )
    return df.select(custom.alias("custom_id"), F.to_json(request).alias("value"))
