"""Registered queries: chat payloads and the audit log, over the conversation turns.

Every turn becomes one request and one answer. Turns are prefixed with a synthetic sample, since
the table itself holds no personal data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pii_spark.operators import audit_log, mask, payloads
from pii_spark.plans import oracle_parts as sql
from pii_spark.plans.corpora import detected_documents, samples, spread, table
from pii_spark.plans.vaults import EPOCH, base_vault

SYSTEM = "You are a helpful assistant."
SHAPES = ["openai", "anthropic", "gemini", "mistral", "plain"]
MODELS = ["gpt-4o-mini", "claude-3-haiku", "gemini-1.5-flash", "mistral-small", "none"]
PATHS = ["/v1/chat/completions", "/v1/messages", "/v1beta/models/gemini-1.5-flash:generateContent",
         "/v1/chat/completions", "/other"]


def turns(spark, sf):
    """Turns with text, provider shape, model, path and time."""
    rows = spread(table(spark, sf, "conversations"), "conv_id", "turn")
    notes = samples(spark, sf).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("note"))
    shape = ((F.col("conv_id") + F.col("turn")) % len(SHAPES)).cast("int")

    def choose(options):
        return F.get(F.array(*[F.lit(o) for o in options]), shape)

    joined = rows.join(notes, "conv_id", "left")
    return joined.select(
        "conv_id", "turn", "role",
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tkey"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 600 + F.col("turn") * 30).alias("ts"),
        F.concat_ws(" ", "note", "text").alias("text"),
        choose(SHAPES).alias("shape"), choose(MODELS).alias("model"), choose(PATHS).alias("path"),
    )


def _chat(role, content):
    return F.struct(role.alias("role"), content.alias("content"))


def requests(spark, sf):
    """Turns with the request ``body`` in their provider's shape."""
    t = turns(spark, sf)
    role, text, model = F.col("role"), F.col("text"), F.col("model")
    openai = F.to_json(F.struct(model, F.array(_chat(F.lit("system"), F.lit(SYSTEM)), _chat(role, text)).alias("messages"), F.lit(0.5).alias("temperature")))
    mistral = F.to_json(F.struct(F.lit("mistral").alias("provider"), model, F.array(_chat(F.lit("system"), F.lit(SYSTEM)), _chat(role, text)).alias("messages")))
    blocks = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    anthropic = F.to_json(F.struct(model, F.lit(SYSTEM).alias("system"), F.array(_chat(role, blocks)).alias("messages")))
    parts = F.array(F.struct(text.alias("text")))
    gemini = F.to_json(F.struct(F.array(F.struct(role, parts.alias("parts"))).alias("contents")))
    body = (
        F.when(F.col("shape") == "openai", openai).when(F.col("shape") == "mistral", mistral)
        .when(F.col("shape") == "anthropic", anthropic).when(F.col("shape") == "gemini", gemini)
        .otherwise(text)
    )
    routed = t.withColumn("body", body)
    return routed.withColumn("provider", payloads.route_provider(F.col("body"), F.col("path")))


def masked_requests(spark, sf):
    return payloads.mask_payloads(requests(spark, sf))


def answers(spark, sf):
    """Masked requests with a ``response`` that repeats the masked text."""
    m = masked_requests(spark, sf)
    text = F.concat(
        F.lit("You wrote: "),
        F.when(F.col("shape") == "plain", F.col("masked_body")).when(
            F.col("shape") == "anthropic",
            F.get_json_object("masked_body", "$.messages[0].content[0].text"),
        ).when(
            F.col("shape") == "gemini", F.get_json_object("masked_body", "$.contents[0].parts[0].text")
        ).otherwise(F.get_json_object("masked_body", "$.messages[1].content")),
    )
    m = m.withColumn("answer", text)
    answer, model = F.col("answer"), F.col("model")
    chat = F.to_json(F.struct(model, F.array(F.struct(_chat(F.lit("assistant"), answer).alias("message"))).alias("choices")))
    blocks = F.to_json(F.struct(model, F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), answer.alias("text"))).alias("content")))
    candidates = F.to_json(F.struct(model.alias("modelVersion"), F.array(F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    response = (
        F.when(F.col("shape") == "plain", answer).when(F.col("shape") == "anthropic", blocks)
        .when(F.col("shape") == "gemini", candidates).otherwise(chat)
    )
    return m.withColumn("response", response)


def restored(spark, sf):
    return payloads.restore_payloads(answers(spark, sf))


def transactions(spark, sf):
    return audit_log.build_log_rows(restored(spark, sf), "tkey")


def request_rows(spark, sf):
    """The log's rows of original requests alone, without their answers."""
    return audit_log.build_log_rows(masked_requests(spark, sf), "tkey", ["request_original"])


def log(spark, sf):
    return audit_log.to_log(transactions(spark, sf))


def masked_conversations(spark, sf):
    m = mask.mask_conversations(turns(spark, sf))
    return m.select("conv_id", "turn", F.md5("masked_text").alias("masked_md5"), F.size("entities").cast("bigint").alias("entities"))


def conversation_vault(spark, sf):
    return mask.conversation_vault(mask.mask_conversations(turns(spark, sf)))


def routed_payloads(spark, sf):
    r = requests(spark, sf)
    return r.select(
        "tkey", F.coalesce("provider", F.lit("none")).alias("provider"),
        (F.get_json_object(payloads.strip_provider(F.col("body")), "$.provider").isNull()).alias("stripped"),
    )


def payload_texts(spark, sf):
    r = requests(spark, sf)
    who = F.col("provider")
    return r.select("tkey", F.md5(payloads.request_text(F.col("body"), who)).alias("text_md5"))


def masked_payloads(spark, sf):
    m = masked_requests(spark, sf)
    flat = F.when(F.col("shape") == "plain", F.col("masked_body")).otherwise(
        audit_log.format_messages(F.transform(
            audit_log.parse_messages(F.col("masked_body"), F.lit("request")),
            lambda x: F.struct(x["role"].alias("role"), F.md5(x["content"]).alias("content")),
        ))
    )
    return m.select("tkey", "mask_status", flat.alias("messages"), F.size("entities").cast("bigint").alias("entities"),
                    F.size("masked_to_original").cast("bigint").alias("mapped"))


def restored_payloads(spark, sf):
    r = restored(spark, sf)
    text = payloads.response_text(F.col("restored_body"), F.col("provider"))
    return r.select("tkey", F.md5(F.when(F.col("shape") != "plain", text)).alias("answer_md5"))


def log_rows(spark, sf):
    rows = transactions(spark, sf)
    return rows.select(
        "id", "direction", F.unix_timestamp("timestamp").alias("ts"), "blocked",
        F.size("detected_pii").cast("bigint").alias("detected"),
        F.coalesce(F.get_json_object("message", "$._transaction_id") == F.col("transaction_id"), F.lit(False)).alias("tagged"),
    )


def log_messages(spark, sf):
    rows = log(spark, sf)
    return rows.select(
        "id", "model", F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), ",").alias("digest"),
    )


def log_page(spark, sf):
    return audit_log.page_logs(log(spark, sf), 100, 50).select("id", "direction", F.unix_timestamp("timestamp").alias("ts"))


def log_display(spark, sf):
    rows = log(spark, sf)
    shown = audit_log.display_text(F.col("messages"), F.when(F.size("messages") > 0, F.col("message")).otherwise(F.lit("")))
    return rows.select(
        "id", audit_log.direction_label(F.col("direction"), F.col("model")).alias("label"),
        audit_log.provider_from_model(F.col("model")).alias("provider"),
        audit_log.format_entities(F.col("detected_pii")).alias("entities"),
        audit_log.format_messages(F.col("messages")).alias("line"),
        F.md5(shown).alias("display_md5"),
    )


def log_stats(spark, sf):
    return audit_log.log_stats(transactions(spark, sf), base_vault(spark, sf)).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("log_rows", "log_limit", "vault_rows", "vault_limit")]
    )


def log_transactions(spark, sf):
    rows = audit_log.order_transactions(transactions(spark, sf))
    return rows.select("id", "direction", F.col("step").cast("bigint").alias("step"), F.unix_timestamp("latest").alias("latest"))


def misclassification_report(spark, sf):
    r = audit_log.misclassification_report(detected_documents(spark, sf))
    return r.select("doc_id", F.col("entity_count").cast("bigint").alias("entity_count"), "entity_summary", "report")


def _literal(text):
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def deep_content(spark, sf):
    """Message texts below lists in lists and parts in parts."""
    t = turns(spark, sf)
    body = F.concat(
        F.lit('{"messages":[{"role":"user","content":[["x ",[[{"parts":[{"parts":[[['), _literal(F.col("text")),
        F.lit(']]]}]}]]],{"parts":[{"text":" tail"}]}]}]}'),
    )
    messages = audit_log.parse_messages(body, F.lit("request"))
    return t.select("tkey", F.md5(F.element_at(messages, 1)["content"]).alias("content_md5"))


def masked_deep_blocks(spark, sf):
    """Texts in the system prompt, in a content object and in the input of a tool."""
    t = turns(spark, sf).withColumn("t", _literal(F.col("text")))
    body = F.concat(
        F.lit('{"system":'), "t", F.lit(',"messages":[{"role":"user","content":{"text":'), "t",
        F.lit('}},{"role":"user","content":[{"type":"tool_use","input":{"to":{"deep":[[[{"a":'), "t", F.lit("}]]]}}}]}]}"),
    )
    m = payloads.mask_payloads(t.select("tkey", body.alias("body"), F.lit("anthropic").alias("provider")))
    paths = {"system": "$.system", "object": "$.messages[0].content.text", "input": "$.messages[1].content[0].input.to.deep[0][0][0].a"}
    return m.select(
        "tkey", "mask_status", *[F.md5(F.get_json_object("masked_body", p)).alias(f"{n}_md5") for n, p in paths.items()],
        F.size("entities").cast("bigint").alias("entities"), F.size("masked_to_original").cast("bigint").alias("mapped"),
    )


CUSTOM = "https://thther.example.org:8443/v1"


def routed_hosts(spark, sf):
    """Requests that only their host tells: pages' hosts, and those of two providers."""
    p = table(spark, sf, "pages").select("page_id", "url")
    own = F.call_function("try_parse_url", F.col("url"), F.lit("HOST"))
    host = (
        F.when(F.col("page_id") % 4 == 0, F.lit("API.Mistral.ai:443")).when(F.col("page_id") % 4 == 1, F.lit("api.openai.com"))
        .otherwise(own)
    )
    routed = payloads.route_provider(F.lit("{}"), F.lit("/v2/other"), host, custom=CUSTOM)
    return p.select("page_id", F.coalesce(routed, F.lit("none")).alias("provider"))


def response_envelope(spark, sf):
    r = payloads.add_envelope(restored(spark, sf), F.col("ts"), "masking service")
    return r.select(
        "tkey", (F.col("shape") == "plain").alias("plain"),
        F.get_json_object("restored_body", "$.proxy_metadata.timestamp").cast("bigint").alias("at"),
        F.get_json_object("restored_body", "$.proxy_metadata.service").alias("service"),
        F.md5(payloads.response_text(F.get_json_object("restored_body", "$.original_response"), F.col("provider"))).alias("original_md5"),
        F.md5(F.when(F.col("shape") != "plain", payloads.response_text(F.col("restored_body"), F.col("provider")))).alias("answer_md5"),
    )


QUERIES = {
    "routed_hosts": routed_hosts,
    "response_envelope": response_envelope,
    "deep_content": deep_content,
    "masked_deep_blocks": masked_deep_blocks,
    "masked_conversations": masked_conversations,
    "conversation_vault": conversation_vault,
    "routed_payloads": routed_payloads,
    "payload_texts": payload_texts,
    "masked_payloads": masked_payloads,
    "restored_payloads": restored_payloads,
    "log_rows": log_rows,
    "log_messages": log_messages,
    "log_page": log_page,
    "log_display": log_display,
    "log_stats": log_stats,
    "log_transactions": log_transactions,
    "misclassification_report": misclassification_report,
}


def oracles() -> dict[str, str]:
    n = len(SHAPES)
    base = f"""WITH {sql.synthetic()}, turns AS (
  SELECT c.conv_id, c.turn, c.role, c.conv_id || '-' || c.turn AS tkey, {EPOCH} + c.conv_id * 600 + c.turn * 30 AS ts,
    CASE WHEN g.text IS NULL THEN c.text ELSE g.text || ' ' || c.text END AS text,
    {sql.word_list(SHAPES)}[(c.conv_id + c.turn) % {n} + 1] AS shape,
    {sql.word_list(MODELS)}[(c.conv_id + c.turn) % {n} + 1] AS model
  FROM conversations c LEFT JOIN gold_text g ON g.doc_id = c.conv_id
)"""
    spans = f"{base}, {sql.rule_spans('spans', 'turns', 'tkey', 'text')}, {sql.with_dummy('d', 'spans')}"
    masked = f"{spans}, {sql.masked_texts('m', 'd', 'turns', 'tkey', 'text')}, k AS (SELECT tkey, count(*) AS n, count(DISTINCT dummy) AS u, string_agg(label || ': ' || original, ', ' ORDER BY s) AS found FROM d GROUP BY tkey)"
    # The four rows of a transaction with the texts they carry.
    rows = f"""{masked}, tx AS (
  SELECT t.*, m.masked_text, md5('transaction|' || t.tkey) AS tid, coalesce(k.n, 0)::BIGINT AS n, k.found
  FROM turns t JOIN m ON m.tkey = t.tkey LEFT JOIN k ON k.tkey = t.tkey
), lg AS (
  SELECT *, tid || '-0' AS id, 'request_original' AS direction, 1 AS step, text AS body FROM tx
  UNION ALL SELECT *, tid || '-1', 'request_masked', 2, masked_text FROM tx
  UNION ALL SELECT *, tid || '-2', 'response_masked', 3, 'You wrote: ' || masked_text FROM tx
  UNION ALL SELECT *, tid || '-3', 'response_original', 4, 'You wrote: ' || text FROM tx
), parsed AS (
  SELECT *, CASE WHEN step > 2 THEN 'assistant' ELSE role END AS r,
    CASE WHEN shape = 'plain' THEN 0 WHEN step <= 2 AND shape IN ('openai', 'mistral') THEN 2 ELSE 1 END AS nm,
    CASE WHEN shape = 'plain' OR (shape = 'gemini' AND step <= 2) THEN NULL ELSE model END AS md
  FROM lg
)"""
    provider = """CASE WHEN md LIKE '%gpt%' THEN 'OpenAI' WHEN md LIKE '%claude%' THEN 'Anthropic'
  WHEN md LIKE '%gemini%' THEN 'Gemini' WHEN md LIKE '%mistral%' THEN 'Mistral' ELSE 'Provider' END"""
    short = "CASE WHEN length(body) > 100 THEN substr(body, 1, 97) || '...' ELSE body END"
    shown = f"""CASE nm WHEN 0 THEN 'No message content' WHEN 2 THEN '[system] {SYSTEM}' || chr(10) || chr(10) || '[' || r || '] ' || body
  ELSE '[' || r || '] ' || body END"""
    return {
        "routed_hosts": r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'mistral' WHEN page_id % 4 = 1 THEN 'openai'
  WHEN host = 'thther.example.org' THEN 'custom' ELSE 'none' END AS provider FROM h""",
        "response_envelope": f"""{masked} SELECT t.tkey, shape = 'plain' AS plain, CASE WHEN shape <> 'plain' THEN ts * 1000 END::BIGINT AS at,
  CASE WHEN shape <> 'plain' THEN 'masking service' END AS service,
  CASE WHEN shape <> 'plain' THEN md5('You wrote: ' || masked_text || chr(10)) END AS original_md5,
  CASE WHEN shape <> 'plain' THEN md5('You wrote: ' || text || chr(10)) END AS answer_md5 FROM turns t JOIN m ON m.tkey = t.tkey""",
        "deep_content": f"{base} SELECT tkey, md5('x ' || text || ' tail') AS content_md5 FROM turns",
        "masked_deep_blocks": f"""{masked} SELECT t.tkey, 'masked' AS mask_status, md5(masked_text) AS system_md5, md5(masked_text) AS object_md5,
  md5(masked_text) AS input_md5, 3 * coalesce(k.n, 0)::BIGINT AS entities, coalesce(k.u, 0)::BIGINT AS mapped
FROM turns t JOIN m ON m.tkey = t.tkey LEFT JOIN k ON k.tkey = t.tkey""",
        "masked_conversations": f"{masked} SELECT conv_id, turn, md5(masked_text) AS masked_md5, coalesce(k.n, 0)::BIGINT AS entities FROM turns t JOIN m ON m.tkey = t.tkey LEFT JOIN k ON k.tkey = t.tkey",
        "conversation_vault": f"{spans} SELECT DISTINCT t.conv_id, original, label, dummy FROM d JOIN turns t ON t.tkey = d.tkey",
        "routed_payloads": f"{base} SELECT tkey, CASE shape WHEN 'plain' THEN 'none' ELSE shape END AS provider, true AS stripped FROM turns",
        "payload_texts": f"""{base} SELECT tkey, CASE shape WHEN 'plain' THEN NULL WHEN 'anthropic' THEN md5('') WHEN 'gemini' THEN md5(text || chr(10))
  ELSE md5('{SYSTEM}' || chr(10) || text || chr(10)) END AS text_md5 FROM turns""",
        "masked_payloads": f"""{masked} SELECT t.tkey, CASE shape WHEN 'plain' THEN 'text' ELSE 'masked' END AS mask_status,
  CASE WHEN shape = 'plain' THEN masked_text WHEN shape IN ('openai', 'mistral')
    THEN '[system] ' || md5('{SYSTEM}') || ' | [' || role || '] ' || md5(masked_text) ELSE '[' || role || '] ' || md5(masked_text) END AS messages,
  coalesce(k.n, 0)::BIGINT AS entities, coalesce(k.u, 0)::BIGINT AS mapped
FROM turns t JOIN m ON m.tkey = t.tkey LEFT JOIN k ON k.tkey = t.tkey""",
        "restored_payloads": f"{base} SELECT tkey, CASE WHEN shape <> 'plain' THEN md5('You wrote: ' || text || chr(10)) END AS answer_md5 FROM turns",
        "log_rows": f"""{rows} SELECT id, direction, ts::BIGINT AS ts, false AS blocked, CASE WHEN step <= 2 THEN n ELSE 0 END::BIGINT AS detected,
  shape <> 'plain' AS tagged FROM lg""",
        "log_messages": f"""{rows} SELECT id, md AS model, nm::BIGINT AS n_messages, CASE nm WHEN 0 THEN '' WHEN 2
  THEN 'system:' || md5('{SYSTEM}') || ',' || r || ':' || md5(body) ELSE r || ':' || md5(body) END AS digest FROM parsed""",
        "log_page": f"{rows} SELECT id, direction, ts::BIGINT AS ts FROM lg ORDER BY lg.ts DESC, id DESC LIMIT 100 OFFSET 50",
        "log_display": f"""{rows}, s AS (SELECT *, {shown} AS shown FROM parsed)
SELECT id, CASE direction WHEN 'request_original' THEN 'Request (Original)' WHEN 'request_masked' THEN 'Request (To ' || {provider} || ')'
  WHEN 'response_masked' THEN 'Response (From ' || {provider} || ')' ELSE 'Response (Restored)' END AS label,
  {provider} AS provider, CASE WHEN step <= 2 THEN coalesce(found, 'None') ELSE 'None' END AS entities,
  CASE nm WHEN 0 THEN '' WHEN 2 THEN '[system] {SYSTEM} | [' || r || '] ' || {short} ELSE '[' || r || '] ' || {short} END AS line,
  md5(CASE WHEN length(shown) > 5000 THEN substr(shown, 1, 5000) || chr(10) || chr(10) || '... [Message truncated for display]' ELSE shown END) AS display_md5
FROM s""",
        "log_stats": f"{base} SELECT (SELECT 4 * count(*) FROM turns)::BIGINT AS log_rows, 5000::BIGINT AS log_limit, (SELECT count(DISTINCT original) FROM gold)::BIGINT AS vault_rows, 10000::BIGINT AS vault_limit",
        "log_transactions": f"{rows} SELECT id, direction, step::BIGINT AS step, ts::BIGINT AS latest FROM lg",
        "misclassification_report": f"""WITH {sql.rule_spans('spans', 'documents')}, a AS (
  SELECT doc_id, count(*) AS n, string_agg(label || ': "' || original || '" (confidence: ' || printf('%.1f', c * 100) || '%)', ', ' ORDER BY s) AS t
  FROM spans GROUP BY doc_id
) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS entity_count, coalesce(t, '') AS entity_summary,
  'PII Misclassification: ' || coalesce(n, 0) || ' entities detected - ' ||
  CASE WHEN length(coalesce(t, '')) > 100 THEN substr(t, 1, 100) || '...' ELSE coalesce(t, '') END AS report
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
    }
