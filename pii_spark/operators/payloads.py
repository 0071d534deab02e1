"""Chat payloads of several providers: route, read, mask and restore their texts.

Payloads are JSON strings. Only message texts change; all other fields are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import bind, compute_once, empty, let_sql, maxima_sql, text_literal, totals_sql
from pii_spark.functions.spans import first_by_key_sql, longest_first
from pii_spark.operators.detect import RULES, detected_sql, host_of
from pii_spark.operators.mask import masked_sql

OBJECT = "map<string,variant>"
LIST = "array<variant>"


def field_sql(v: str, path: str) -> str:
    """A field only if it is a JSON string."""
    value = f"try_variant_get({v}, '{path}', 'variant')"
    return f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END"


def list_sql(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', '{LIST}')"


def object_sql(v: str) -> str:
    return f"try_cast({v} AS {OBJECT})"


def put_sql(obj: str, name: str, value: str) -> str:
    """The object with one field set."""
    return f"map_concat(map_filter({obj}, (k, v) -> k <> '{name}'), map('{name}', {value}))"


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def field_string(v: Column, path: str) -> Column:
    return let_sql(v, field_sql("x", path))


def field_list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, LIST)


def route_provider(
    body: Column, path: Column, host: Column | None = None, default: str = "openai", custom: str | None = None
) -> Column:
    """Provider by the body's ``provider`` field, else by path, else by host; null if unknown.

    Two providers share one path; ``default`` decides between them. A host must equal a provider's,
    without its port; ``custom`` is the address of the user's own provider, which speaks the shape of
    ``openai``.
    """
    if default not in ("openai", "mistral"):
        raise ValueError(f"unknown default provider: {default}")
    named = field_string(parsed(body), "$.provider")
    by_path = None
    for known, provider in fv.PROVIDER_PATHS.items():
        value = F.lit(default if provider == "openai" else provider)
        by_path = F.when(path == known, value) if by_path is None else by_path.when(path == known, value)
    by_path = by_path.when(path.startswith(fv.GEMINI_PATH_PREFIX), F.lit("gemini"))
    choice = [F.when(named.isin(*fv.PROVIDERS), named), by_path]
    if host is not None:
        own = (urlsplit(custom if "://" in custom else f"//{custom}").hostname or "").lower() if custom else ""
        domains = {**fv.PROVIDER_HOSTS, **({"custom": own} if own else {})}
        choice += [F.when(host_of(host) == domain, provider) for provider, domain in domains.items()]
    return F.coalesce(*choice)


def strip_provider(body: Column) -> Column:
    """The body without its ``provider`` field; non-JSON and other bodies unchanged."""
    stripped = "to_json(map_filter(o, (k, v) -> k <> 'provider'))"
    return let_sql(
        body,
        bind(object_sql("try_parse_json(x)"), "o", f"CASE WHEN map_contains_key(o, 'provider') THEN {stripped} ELSE x END"),
    )


def _present(values: str) -> str:
    return f"filter({values}, t -> t IS NOT NULL)"


def _texts_sql(items: str, path: str) -> str:
    return _present(f"transform({items}, m -> {field_sql('m', path)})")


def _parts_sql(items: str, path: str) -> str:
    texts = _texts_sql(list_sql("c", path), "$.text")
    return f"flatten(transform({items}, c -> coalesce({texts}, {empty('array<string>')})))"


def _lines_sql(texts: str) -> str:
    return bind(texts, "ls", r"CASE WHEN ls IS NOT NULL THEN array_join(transform(ls, t -> concat(t, '\n')), '') END")


def _filled_sql(values: str) -> str:
    return bind(values, "vs", "CASE WHEN size(vs) > 0 THEN vs END")


def request_text(body: Column, provider: Column) -> Column:
    """All string message texts of a request, each followed by a newline; null without messages."""
    gemini = _lines_sql(_parts_sql(list_sql("j", "$.contents"), "$.parts"))
    other = _lines_sql(_texts_sql(list_sql("j", "$.messages"), "$.content"))
    return let_sql(
        F.struct(body.alias("b"), provider.alias("p")),
        bind("try_parse_json(x.b)", "j", f"CASE WHEN x.p = 'gemini' THEN {gemini} ELSE {other} END"),
    )


def response_text(body: Column, provider: Column) -> Column:
    """All answer texts of a response, each followed by a newline; null without answers."""
    gemini = _lines_sql(_parts_sql(_filled_sql(list_sql("j", "$.candidates")), "$.content.parts"))
    blocks = f"filter({_filled_sql(list_sql('j', '$.content'))}, b -> {field_sql('b', '$.type')} = 'text')"
    anthropic = _lines_sql(_texts_sql(blocks, "$.text"))
    other = _lines_sql(_texts_sql(_filled_sql(list_sql("j", "$.choices")), "$.message.content"))
    return let_sql(
        F.struct(body.alias("b"), provider.alias("p")),
        bind(
            "try_parse_json(x.b)", "j",
            f"CASE WHEN x.p = 'gemini' THEN {gemini} WHEN x.p = 'anthropic' THEN {anthropic} ELSE {other} END",
        ),
    )


Change = Callable[[str], str]


def _change_field(item: str, name: str, change: Change) -> str:
    """A VARIANT object with its string field ``name`` changed; anything else as it is."""
    changed = put_sql(object_sql(item), name, f"CAST({change('txt')} AS VARIANT)")
    return bind(
        field_sql(item, f"$.{name}"), "txt",
        f"CASE WHEN txt IS NOT NULL THEN to_variant_object({changed}) ELSE {item} END",
    )


def _change_list(item: str, name: str, var: str, each: str) -> str:
    """A VARIANT object with every element ``var`` of its list field replaced by ``each``."""
    xs = f"{var}s"
    changed = put_sql(object_sql(item), name, f"to_variant_object(transform({xs}, {var} -> {each}))")
    return bind(
        list_sql(item, f"$.{name}"), xs,
        f"CASE WHEN {xs} IS NOT NULL THEN to_variant_object({changed}) ELSE {item} END",
    )


def _change_object(item: str, name: str, var: str, changed: str) -> str:
    return bind(
        f"try_variant_get({item}, '$.{name}', 'variant')", var,
        f"CASE WHEN {object_sql(var)} IS NOT NULL THEN to_variant_object({put_sql(object_sql(item), name, changed)}) ELSE {item} END",
    )


def response_sql(v: str, provider: str, change: Change) -> str:
    """The response VARIANT with ``change`` applied to every answer text."""
    block = f"CASE WHEN {field_sql('blk', '$.type')} = 'text' THEN {_change_field('blk', 'text', change)} ELSE blk END"
    parts = _change_list("obj", "parts", "prt", _change_field("prt", "text", change))
    gemini = _change_list(v, "candidates", "cnd", _change_object("cnd", "content", "obj", parts))
    choice = _change_object("chc", "message", "obj", _change_field("obj", "content", change))
    return (
        f"CASE WHEN {provider} = 'gemini' THEN {gemini} "
        f"WHEN {provider} = 'anthropic' THEN {_change_list(v, 'content', 'blk', block)} "
        f"ELSE {_change_list(v, 'choices', 'chc', choice)} END"
    )


def scanned_sql(body: str) -> str:
    """SQL text that cuts JSON into its string literals and the gaps around them.

    Repetitions are possessive, so that the expression neither backtracks nor recurses.
    """
    literal = text_literal(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"')
    return f"named_struct('literals', regexp_extract_all({body}, {literal}, 0), 'gaps', split({body}, {literal}, -1))"


def leaves_sql(scan: str) -> str:
    """SQL text of the decoded texts of the literals of ``scanned_sql`` that belong to messages, null for others.

    Running totals of the brackets in the gaps give the depth of a literal; the last key on the first
    level names the field that it is in, at whatever depth.
    """
    opened = totals_sql(f"transform({scan}.gaps, g -> length(g) - length(translate(g, '[{{', '')))")
    closed = totals_sql(f"transform({scan}.gaps, g -> length(g) - length(translate(g, ']}}', '')))")
    colon = "RLIKE '^\\\\s*:'"
    is_key = f"get({scan}.gaps, i + 1) {colon}"
    fields = maxima_sql(
        f"transform({scan}.literals, (l, i) -> CASE WHEN {is_key} AND get(opened, i) - get(closed, i) = 1 THEN i + 1 ELSE 0 END)"
    )
    decoded = "get_json_object(concat('[', {}, ']'), '$[0]')"
    field = decoded.format(f"get({scan}.literals, get(fields, i) - 1)")
    key = f"CASE WHEN get({scan}.gaps, i) {colon} THEN {decoded.format(f'get({scan}.literals, i - 1)')} END"
    text = (
        f"CASE WHEN NOT {is_key} AND get(fields, i) > 0 AND {field} IN ({_listed(fv.TEXT_FIELDS)}) "
        f"AND NOT coalesce({key} IN ({_listed(fv.NAMING_KEYS)}), false) THEN {decoded.format('l')} END"
    )
    return bind(opened, "opened", bind(closed, "closed", bind(fields, "fields", f"transform({scan}.literals, (l, i) -> {text})")))


def _listed(values: list[str]) -> str:
    return ", ".join(text_literal(v) for v in values)


def mask_payloads(df: DataFrame, body: str = "body", provider: str = "provider", salt: str = "", rules=RULES) -> DataFrame:
    """Add ``masked_body``, ``masked_to_original``, ``entities`` and ``mask_status``.

    Status is ``masked`` for a known shape, ``text`` for a body that is no JSON object and is masked as
    a whole, and ``unrecognised`` for an object without the expected list, which passes unchanged. Of a
    known shape every string below the messages and the system prompt is masked, at any depth: texts,
    blocks in blocks, inputs and results of tools. Only the strings with personal data change; all
    other characters of the body stay as they are. Every text is detected and masked once.
    """
    objects = bind("try_parse_json(x.b)", "j", f"CASE WHEN {object_sql('j')} IS NOT NULL THEN j END")
    listed = f"CASE WHEN x.p = 'gemini' THEN {list_sql('v', '$.contents')} ELSE {list_sql('v', '$.messages')} END IS NOT NULL"
    shape = bind(objects, "v", f"CASE WHEN v IS NULL THEN 'text' WHEN {listed} THEN 'masked' ELSE 'unrecognised' END")
    # Several steps, since every level of nested functions costs the analyzer several rounds.
    out = df.withColumn("_shape", let_sql(F.struct(F.col(body).alias("b"), F.col(provider).alias("p")), shape))
    out = compute_once(out, "_scan", F.expr(f"CASE WHEN _shape = 'masked' THEN {scanned_sql(f'`{body}`')} END"))
    texts = f"CASE _shape WHEN 'text' THEN array(`{body}`) WHEN 'masked' THEN {leaves_sql('_scan')} END"
    out = compute_once(out, "_texts", F.expr(texts))
    one = bind(detected_sql("t", tuple(rules)), "entities", masked_sql("t", "entities", salt))
    out = compute_once(out, "_done", F.expr(f"transform(_texts, t -> CASE WHEN t IS NOT NULL THEN {one} END)"))
    encoded = bind("to_json(array(get(_done, i).masked_text))", "j", "substring(j, 2, length(j) - 2)")
    literal = f"CASE WHEN size(get(_done, i).entities) > 0 THEN {encoded} ELSE l END"
    rebuilt = (
        f"CASE _shape WHEN 'text' THEN get(_done, 0).masked_text WHEN 'masked' THEN concat(array_join(transform(_scan.literals, "
        f"(l, i) -> concat(get(_scan.gaps, i), {literal})), ''), element_at(_scan.gaps, -1)) ELSE `{body}` END"
    )
    out = out.withColumn("_body", F.expr(rebuilt)).withColumn("_done", F.expr("coalesce(filter(_done, d -> d IS NOT NULL), array())"))
    made = {
        "mask_status": F.col("_shape"), "masked_body": F.col("_body"),
        "masked_to_original": F.expr(_last_wins("transform(_done, d -> d.masked_to_original)")),
        "entities": F.expr("flatten(transform(_done, d -> d.entities))"),
    }
    return out.select(*[c for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def _last_wins(maps: str) -> str:
    """Union of maps; of equal keys the later one stays."""
    return f"map_from_entries({first_by_key_sql(f'reverse(flatten(transform({maps}, mp -> map_entries(mp))))')})"


def restore_payloads(
    df: DataFrame, body: str = "response", provider: str = "provider",
    mapping: str = "masked_to_original", notice: str = "",
) -> DataFrame:
    """Add ``restored_body``: originals back in every answer text, plus an optional notice."""
    inputs = F.struct(
        F.col(body).alias("b"), F.col(provider).alias("p"), longest_first(F.col(mapping)).alias("m")
    )
    back = "aggregate(filter(x.m, e -> e.key <> ''), txt, (acc, e) -> replace(acc, e.key, e.value))"
    if notice:
        back = f"concat({back}, {text_literal(notice)})"
    changed = response_sql("j", "x.p", lambda _: back)
    restored = bind("try_parse_json(x.b)", "j", f"CASE WHEN j IS NULL THEN x.b ELSE to_json({changed}) END")
    return df.withColumn("restored_body", let_sql(inputs, restored))


def add_envelope(
    df: DataFrame, at: Column, service: str, original: str = "response", body: str = "restored_body"
) -> DataFrame:
    """``body`` with ``original_response``, the answer as it came, and ``proxy_metadata``: that it was
    changed, when (``at``, in milliseconds) and by which ``service``. A body that is no JSON object stays."""
    added = (
        "map('original_response', coalesce(try_parse_json(x.o), CAST(x.o AS VARIANT)), 'proxy_metadata', "
        f"to_variant_object(named_struct('intercepted', true, 'timestamp', x.t, 'service', {text_literal(service)})))"
    )
    names = "k NOT IN ('original_response', 'proxy_metadata')"
    whole = bind(
        object_sql("try_parse_json(x.b)"), "j",
        f"CASE WHEN j IS NULL THEN x.b ELSE to_json(map_concat(map_filter(j, (k, v) -> {names}), {added})) END",
    )
    inputs = F.struct(F.col(body).alias("b"), F.col(original).alias("o"), F.unix_millis(at).alias("t"))
    return df.withColumn(body, let_sql(inputs, whole))
