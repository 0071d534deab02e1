"""The request and response log: rows, parsing, pages and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import bind, empty, let, let_sql, text_literal
from pii_spark.operators.payloads import field_sql, list_sql, object_sql, put_sql

MESSAGES = "array<struct<role:string,content:string>>"
DETECTED = "array<struct<original_pii:string,pii_type:string,confidence:double>>"
REQUEST_DIRECTIONS = ["request", "In", "request_original", "request_masked"]
RESPONSE_DIRECTIONS = ["response", "Out", "response_original", "response_masked"]


def add_transaction_id(message: Column, transaction: Column) -> Column:
    """A JSON object gains ``_transaction_id``; other messages stay."""
    tagged = put_sql("o", "_transaction_id", "CAST(x.t AS VARIANT)")
    return let_sql(
        F.struct(message.alias("m"), transaction.alias("t")),
        bind(object_sql("try_parse_json(x.m)"), "o", f"CASE WHEN o IS NOT NULL THEN to_json({tagged}) ELSE x.m END"),
    )


def transaction_id(key: Column) -> Column:
    """Stable under reruns, unlike a random id."""
    return F.md5(F.concat(F.lit("transaction|"), key.cast("string")))


def build_log_rows(tx: DataFrame, key: str, directions: list[str] = fv.DIRECTIONS) -> DataFrame:
    """Four rows per transaction, in the order original and masked request, masked and restored
    response. Needs ``ts, body, masked_body, response, restored_body, entities``; with fewer
    ``directions``, only their rows are made, and only what they need is computed."""
    bodies = ["body", "masked_body", "response", "restored_body"]
    none = F.array().cast(DETECTED)
    found = F.transform(
        "entities",
        lambda e: F.struct(
            e["text"].alias("original_pii"), e["label"].alias("pii_type"), e["confidence"].alias("confidence")
        ),
    ).cast(DETECTED)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(direction).alias("direction"),
            add_transaction_id(F.col(b), F.col("transaction_id")).alias("message"),
            (found if i < 2 else none).alias("detected_pii"),
        )
        for i, (direction, b) in enumerate(zip(fv.DIRECTIONS, bodies)) if direction in directions
    ])
    return (
        tx.withColumn("transaction_id", transaction_id(F.col(key)))
        .select(key, "transaction_id", "ts", F.explode(rows).alias("r"))
        .select(
            F.concat_ws("-", "transaction_id", F.col("r.step").cast("string")).alias("id"),
            "transaction_id", F.col("ts").alias("timestamp"), "r.direction", "r.message",
            "r.detected_pii", F.lit(False).alias("blocked"),
        )
    )


def truncated(message: Column, limit: int = fv.MAX_LOG_MESSAGE) -> Column:
    return F.when(
        F.length(message) > limit, F.concat(F.substring(message, 1, limit), F.lit("... [truncated]"))
    ).otherwise(message)


def to_log(rows: DataFrame) -> DataFrame:
    """Log rows as stored: messages and model are parsed out of the whole message, and only the stored
    copy of a long one is cut, which ``truncated`` tells."""
    cut = F.coalesce(F.length("message") > fv.MAX_LOG_MESSAGE, F.lit(False))
    return add_messages(rows).withColumn("truncated", cut).withColumn("message", truncated(F.col("message")))


def content_sql(v: str, levels: str) -> str:
    """Text of a content value: a string, a list of contents, or an object with text, content or
    parts; empty otherwise.

    Every round replaces lists and parts by their elements, in place, until only strings are left;
    ``levels`` is an upper bound of the nesting, and rounds after the last one do nothing.
    """
    string = field_sql("c", "$")
    inner = (
        f"CASE WHEN {string} IS NOT NULL THEN array(c) WHEN {list_sql('c', '$')} IS NOT NULL THEN {list_sql('c', '$')} "
        f"WHEN {field_sql('c', '$.text')} IS NOT NULL THEN array(CAST({field_sql('c', '$.text')} AS VARIANT)) "
        f"WHEN {field_sql('c', '$.content')} IS NOT NULL THEN array(CAST({field_sql('c', '$.content')} AS VARIANT)) "
        f"ELSE coalesce({list_sql('c', '$.parts')}, {empty('array<variant>')}) END"
    )
    opened = bind(
        f"flatten(transform(acc.items, c -> {inner}))", "next",
        "named_struct('items', next, 'open', coalesce(exists(next, c -> schema_of_variant(c) <> 'STRING'), false))",
    )
    return (
        f"aggregate(sequence(0, {levels}), named_struct('items', array({v}), 'open', true), (acc, k) -> "
        f"CASE WHEN acc.open THEN {opened} ELSE acc END, "
        f"acc -> array_join(transform(acc.items, c -> coalesce({string}, '')), ''))"
    )


def _levels_sql(json: str) -> str:
    """No value in ``json`` is nested deeper than it has opening brackets."""
    return f"length({json}) - length(translate({json}, '[{{', ''))"


def message_content(v: Column) -> Column:
    return let_sql(v, bind(_levels_sql("to_json(x)"), "levels", content_sql("x", "levels")))


def _role_sql(v: str, path: str, default: str) -> str:
    return f"coalesce(nullif({field_sql(v, path)}, ''), '{default}')"


def _messages_sql(items: str, path: str) -> str:
    """(role, content) of the objects of a list; a missing or empty role is user."""
    content = content_sql("c", "levels")
    one = (
        f"named_struct('role', {_role_sql('m', '$.role', 'user')}, 'content', "
        + bind(f"try_variant_get(m, '{path}', 'variant')", "c", content) + ")"
    )
    return f"transform(filter({items}, m -> {object_sql('m')} IS NOT NULL), m -> {one})"


def _filled_sql(values: str) -> str:
    return bind(values, "vs", "CASE WHEN size(vs) > 0 THEN vs END")


def request_messages_sql(v: str) -> str:
    return (
        f"coalesce({_filled_sql(_messages_sql(list_sql(v, '$.messages'), '$.content'))}, "
        f"{_filled_sql(_messages_sql(list_sql(v, '$.contents'), '$.parts'))})"
    )


def response_messages_sql(v: str) -> str:
    content = bind("try_variant_get(c, '$.message.content', 'variant')", "cc", content_sql("cc", "levels"))
    text = field_sql("c", "$.text")
    message = "try_variant_get(c, '$.message', 'variant')"
    choice = (
        f"CASE WHEN {object_sql(message)} IS NOT NULL "
        f"THEN named_struct('role', {_role_sql('c', '$.message.role', 'assistant')}, 'content', {content}) "
        f"WHEN coalesce({text}, '') <> '' THEN named_struct('role', 'assistant', 'content', {text}) END"
    )
    choices = _filled_sql(f"filter(transform({list_sql(v, '$.choices')}, c -> {choice}), m -> m IS NOT NULL)")
    texts = (
        f"filter(transform(filter({list_sql(v, '$.content')}, b -> {field_sql('b', '$.type')} = 'text'), "
        f"b -> coalesce({field_sql('b', '$.text')}, '')), t -> t <> '')"
    )
    blocks = bind(
        texts, "ts",
        f"CASE WHEN size(ts) > 0 THEN array(named_struct('role', {_role_sql(v, '$.role', 'assistant')}, "
        "'content', array_join(ts, ''))) END",
    )
    parts = bind("try_variant_get(c, '$.content.parts', 'variant')", "cc", content_sql("cc", "levels"))
    candidates = _filled_sql(
        f"filter(transform({list_sql(v, '$.candidates')}, c -> named_struct('role', 'assistant', 'content', {parts})), "
        "m -> m.content <> '')"
    )
    return f"coalesce({choices}, {blocks}, {candidates})"


def _one_of(name: str, values: list[str]) -> str:
    return f"{name} IN ({', '.join(text_literal(v) for v in values)})"


def parse_messages(message: Column, direction: Column) -> Column:
    """ARRAY of (role, content); empty for other directions and non-JSON messages."""
    found = (
        f"CASE WHEN {_one_of('x.d', REQUEST_DIRECTIONS)} THEN CAST({request_messages_sql('j')} AS {MESSAGES}) "
        f"WHEN {_one_of('x.d', RESPONSE_DIRECTIONS)} THEN CAST({response_messages_sql('j')} AS {MESSAGES}) END"
    )
    return let_sql(
        F.struct(message.alias("m"), direction.alias("d")),
        bind("try_parse_json(x.m)", "j", bind(_levels_sql("x.m"), "levels", f"coalesce({found}, {empty(MESSAGES)})")),
    )


def extract_model(message: Column) -> Column:
    """Model name of a payload or of the response inside it; null if there is none."""
    paths = ["$.model", "$.modelVersion", "$.original_response.model", "$.original_response.modelVersion"]
    fields = ", ".join(f"nullif({field_sql('j', p)}, '')" for p in paths)
    return let_sql(message, bind("try_parse_json(x)", "j", f"coalesce({fields})"))


def add_messages(rows: DataFrame) -> DataFrame:
    return rows.withColumn("messages", parse_messages(F.col("message"), F.col("direction"))).withColumn(
        "model", extract_model(F.col("message"))
    )


def page_logs(log: DataFrame, limit: int = fv.LOG_PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page, newest first; ids break ties so that pages do not overlap."""
    size = min(limit if limit > 0 else fv.LOG_PAGE_DEFAULT, fv.LOG_PAGE_MAX)
    return log.orderBy(F.desc("timestamp"), F.desc("id")).offset(max(offset, 0)).limit(size)


def format_entities(detected: Column) -> Column:
    return F.when(
        F.size(detected) > 0,
        F.array_join(
            F.transform(detected, lambda e: F.concat(e["pii_type"], F.lit(": "), e["original_pii"])), ", "
        ),
    ).otherwise(F.lit("None"))


def format_messages(messages: Column) -> Column:
    """``[role] content`` of all messages; a content over 100 characters is cut to 97 and dots."""
    def one(m: Column) -> Column:
        short = F.when(
            F.length(m["content"]) > 100, F.concat(F.substring(m["content"], 1, 97), F.lit("..."))
        ).otherwise(m["content"])
        return F.concat(F.lit("["), m["role"], F.lit("] "), short)

    return F.array_join(F.transform(messages, one), " | ")


def log_stats(log: DataFrame, vault: DataFrame) -> DataFrame:
    """Row counts of both tables with their declared limits."""
    return log.agg(F.count("*").alias("log_rows")).select(
        "log_rows",
        F.lit(fv.MAX_LOG_ROWS).alias("log_limit"),
        vault.agg(F.count("*")).scalar().alias("vault_rows"),
        F.lit(fv.MAX_VAULT_ROWS).alias("vault_limit"),
    )


def order_transactions(log: DataFrame) -> DataFrame:
    """Transactions by latest time, newest first; inside one, the fixed step order.

    Rows without a transaction stand for themselves. A transaction has four rows, so a window over it
    is one shuffle without hot groups, and the input is read once.
    """
    group = F.coalesce("transaction_id", "id")
    rank = F.array_position(F.array(*[F.lit(d) for d in fv.DIRECTIONS]), F.col("direction"))
    rows = log.withColumn("group_id", group).withColumn(
        "step", F.when(rank > 0, rank).otherwise(len(fv.DIRECTIONS) + 1)
    )
    latest = F.max("timestamp").over(W.partitionBy("group_id"))
    return rows.withColumn("latest", latest).orderBy(
        F.desc("latest"), "group_id", "step", "timestamp", "id"
    )


def provider_from_model(model: Column) -> Column:
    m = F.lower(model)
    return (
        F.when(F.contains(m, F.lit("gpt")) | F.contains(m, F.lit("openai")), "OpenAI")
        .when(F.contains(m, F.lit("claude")) | F.contains(m, F.lit("anthropic")), "Anthropic")
        .when(F.contains(m, F.lit("gemini")) | F.contains(m, F.lit("google")), "Gemini")
        .when(F.contains(m, F.lit("mistral")), "Mistral")
        .otherwise("Provider")
    )


def direction_label(direction: Column, model: Column) -> Column:
    provider = provider_from_model(model)
    return (
        F.when(direction == "request_original", "Request (Original)")
        .when(direction == "request_masked", F.concat(F.lit("Request (To "), provider, F.lit(")")))
        .when(direction == "response_masked", F.concat(F.lit("Response (From "), provider, F.lit(")")))
        .when(direction == "response_original", "Response (Restored)")
        .when(direction.isin("request", "In"), "Request")
        .when(direction.isin("response", "Out"), "Response")
        .otherwise(direction)
    )


def display_text(messages: Column, message: Column, limit: int = 5000) -> Column:
    """Role-tagged texts of a log row, or the raw message, cut at ``limit`` characters."""
    tagged = F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), "\n\n"
    )
    shown = F.when(F.size(messages) > 0, tagged).otherwise(
        F.coalesce(F.nullif(message, F.lit("")), F.lit("No message content"))
    )
    return let(
        shown,
        lambda t: F.when(
            F.length(t) > limit,
            F.concat(F.substring(t, 1, limit), F.lit("\n\n... [Message truncated for display]")),
        ).otherwise(t),
    )


def misclassification_report(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Add ``entity_count``, ``entity_summary`` and the one-line ``report`` of reported texts."""
    def one(e: Column) -> Column:
        pct = F.format_string("%.1f", e["confidence"] * 100)
        return F.concat(e["label"], F.lit(': "'), e["text"], F.lit('" (confidence: '), pct, F.lit("%)"))

    out = df.withColumn("entity_count", F.size(entities)).withColumn(
        "entity_summary", F.array_join(F.transform(entities, one), ", ")
    )
    short = F.when(
        F.length("entity_summary") > 100, F.concat(F.substring("entity_summary", 1, 100), F.lit("..."))
    ).otherwise(F.col("entity_summary"))
    return out.withColumn(
        "report",
        F.concat(
            F.lit("PII Misclassification: "), F.col("entity_count").cast("string"),
            F.lit(" entities detected - "), short,
        ),
    )
