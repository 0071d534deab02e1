"""Building blocks of the DuckDB statements that the registered queries are checked with."""

from __future__ import annotations

from pii_spark.functions import fixed_values as fv
from pii_spark.operators import prepare
from pii_spark.operators.detect import RULES, Rule
from pii_spark.operators.synth import TEMPLATES


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word_list(pool: list[str]) -> str:
    return "[" + ", ".join(quote(w) for w in pool) + "]"


def draw(key: str, i: int | str) -> str:
    return f"('0x' || substr(md5({key} || '|' || {i}), 1, 8))::BIGINT"


def pick(pool: list[str], d: str) -> str:
    return f"{word_list(pool)}[({d}) % {len(pool)} + 1]"


def number(d: str, low: int, span: int) -> str:
    return f"(({d}) % {span} + {low})::VARCHAR"


def dummy_columns(label: str, original: str, salt: str = "", attempt: str = "0") -> str:
    """SELECT items ``hk`` and ``d0`` to ``d5`` for ``dummy_value``."""
    key = f"({quote(salt)} || '|' || {label} || '|' || {original} || '|' || {attempt})"
    draws = ", ".join(f"{draw(key, i)} AS d{i}" for i in range(6))
    return f"{key} AS hk, {draws}"


def dummy_value(label: str = "label", original: str = "original") -> str:
    """CASE over the 26 labels; needs the columns of ``dummy_columns``."""

    def other(pool: list[str]) -> str:
        rest = f"list_filter({word_list(pool)}, lambda w: w <> {original})"
        return f"({rest})[d0 % len({rest}) + 1]"

    def letter(d: str, span: int = 26) -> str:
        return f"substr('{fv.LETTERS}', ({d} % {span} + 1)::INT, 1)"

    def chars(pool: str, length: str) -> str:
        hexes = "(md5(hk || '|c0') || md5(hk || '|c1') || md5(hk || '|c2'))"
        one = f"substr({quote(pool)}, (('0x' || substr({hexes}, 2 * i + 1, 2))::INT % {len(pool)} + 1)::INT, 1)"
        return f"array_to_string(list_transform(range({length}), lambda i: {one}), '')"

    third = f"substr({original}, 3, 1)"
    sep = f"(CASE WHEN {third} IN ('/', '-') THEN {third} ELSE '/' END)"
    area, exchange, line = number("d0", 200, 800), number("d1", 200, 800), number("d2", 1000, 9000)
    card = " || ' ' || ".join(number(f"d{i}", 1000, 9000) for i in range(4))
    iban = " || ' ' || ".join(number(f"d{i}", 1000, 9000) for i in range(2, 6))
    values = {
        "EMAIL": f"{pick(fv.EMAIL_FIRST, 'd0')} || '.' || {pick(fv.EMAIL_LAST, 'd1')} || '@' || {pick(fv.EMAIL_DOMAINS, 'd2')}",
        "PHONENUMBER": (
            f"CASE d3 % 3 WHEN 0 THEN {area} || '-' || {exchange} || '-' || {line} "
            f"WHEN 1 THEN {area} || '.' || {exchange} || '.' || {line} "
            f"ELSE '(' || {area} || ') ' || {exchange} || '-' || {line} END"
        ),
        "SSN": f"{number('d0', 100, 900)} || '-' || {number('d1', 10, 90)} || '-' || {number('d2', 1000, 9000)}",
        "CREDITCARDNUMBER": f"CASE d4 % 2 WHEN 0 THEN {card} ELSE replace({card}, ' ', '-') END",
        "USERNAME": f"{pick(fv.USERNAME_PREFIXES, 'd1')} || {number('d0', 1000, 9000)}",
        "DATEOFBIRTH": f"lpad({number('d1', 1, 12)}, 2, '0') || {sep} || lpad({number('d2', 1, 28)}, 2, '0') || {sep} || {number('d0', 1950, 55)}",
        "STREET": pick(fv.STREETS, "d0"),
        "ZIP": f"CASE WHEN substr({original}, 6, 1) = '-' THEN {number('d0', 10000, 89999)} || '-' || {number('d1', 1000, 8999)} ELSE {number('d0', 10000, 89999)} END",
        "CITY": other(fv.CITIES),
        "BUILDINGNUM": f"CASE WHEN d1 % 10 < 3 THEN {number('d0', 1, 999)} || {letter('d2', 6)} ELSE {number('d0', 1, 999)} END",
        "FIRSTNAME": other(fv.FIRST_NAMES),
        "SURNAME": other(fv.SURNAMES),
        "IDCARDNUM": f"{number('d0', 10, 90)} || '-' || {number('d1', 1000000, 8999999)}",
        "DRIVERLICENSENUM": f"{letter('d0')} || {number('d1', 100000000, 899999999)}",
        "TAXNUM": f"{number('d0', 10, 89)} || '-' || {number('d1', 1000000, 8999999)}",
        "URL": f"'https://www.' || {pick(fv.URL_DOMAINS, 'd0')} || '.' || {pick(fv.URL_TLDS, 'd1')} || {pick(fv.URL_PATHS, 'd2')}",
        "COMPANYNAME": f"{pick(fv.COMPANY_PREFIXES, 'd0')} || ' ' || {pick(fv.COMPANY_SUFFIXES, 'd1')}",
        "STATE": other(fv.STATES),
        "COUNTRY": other(fv.COUNTRIES),
        "PASSPORTID": f"{letter('d0')} || {letter('d1')} || {number('d2', 1000000, 8999999)}",
        "NATIONALID": f"{number('d0', 100, 900)} || '-' || {number('d1', 1000, 9000)} || '-' || {number('d2', 1000, 9000)}",
        "LICENSEPLATENUM": f"{letter('d0')} || {letter('d1')} || {letter('d2')} || '-' || {number('d3', 1000, 9000)}",
        "PASSWORD": chars(fv.PASSWORD_CHARS, "d0 % 5 + 12"),
        "IBAN": f"{pick(fv.IBAN_COUNTRIES, 'd0')} || {number('d1', 10, 90)} || ' ' || {iban}",
        "AGE": number("d0", 18, 68),
        "SECURITYTOKEN": f"{pick(fv.TOKEN_PREFIXES, 'd1')} || {chars(fv.TOKEN_CHARS, 'd0 % 9 + 32')}",
    }
    cases = " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in values.items())
    return f"(CASE {label} {cases} ELSE {quote(fv.GENERIC_DUMMY)} END)"


def rule_spans(
    name: str, source: str, key: str = "doc_id", text: str = "text", policy: str = "confidence", more: str = "",
    rules: tuple[Rule, ...] = RULES,
) -> str:
    """CTEs ending in ``name``(key, text, label, start, end, confidence): the merged rule matches.

    ``source`` is a table or CTE; ``more`` a SELECT of further spans (k, t, label, c, s, e). Overlaps
    are folded with list_reduce over (done, current) pairs.
    """
    selects = []
    for n, rule in enumerate(rules):
        beside = rule.before or rule.after
        p = quote(rule.grouped if beside else rule.pattern)
        whole = f"unnest(regexp_extract_all({text}, {p}))"
        parts = [f"unnest(regexp_extract_all({text}, {p}, {k}))" for k in (1, 2)] if beside else [f"unnest(list_transform(regexp_extract_all({text}, {p}), lambda x: ''))", whole]
        selects.append(
            f"SELECT {key} AS k, {text} AS t, {n} AS r, {quote(rule.label)} AS label, {rule.confidence}::DOUBLE AS c, "
            f"{whole} AS w, {parts[0]} AS b, {parts[1]} AS v, unnest(string_split_regex({text}, {p})) AS g, "
            f"generate_subscripts(string_split_regex({text}, {p}), 1) AS i "
            f"FROM {source} WHERE regexp_matches({text}, {p})"
        )
    digits = "replace(replace(v, ' ', ''), '-', '')"
    luhn = (
        f"(length({digits}) = 16 AND list_sum(list_transform(range(16), lambda j: "
        f"CASE WHEN j % 2 = 0 THEN (2 * substr({digits}, j + 1, 1)::INT - CASE WHEN substr({digits}, j + 1, 1)::INT > 4 THEN 9 ELSE 0 END) "
        f"ELSE substr({digits}, j + 1, 1)::INT END)) % 10 = 0)"
    )
    ipv4 = "(len(list_filter(string_split(v, '.'), lambda x: x::BIGINT > 255)) = 0)"
    span = "STRUCT(s BIGINT, e BIGINT, label VARCHAR, c DOUBLE)"
    fold = (
        "CASE WHEN b.cur.s >= a.cur.e THEN {'done': list_append(a.done, a.cur), 'cur': b.cur} "
        "WHEN b.cur.s = a.cur.s AND b.cur.e = a.cur.e THEN {'done': a.done, 'cur': CASE WHEN b.cur.c > a.cur.c THEN b.cur ELSE a.cur END} "
        "WHEN b.cur.label = a.cur.label AND b.cur.e > a.cur.e THEN {'done': a.done, 'cur': {'s': a.cur.s, 'e': b.cur.e, 'label': a.cur.label, 'c': (a.cur.c + b.cur.c) / 2}} "
        "WHEN b.cur.label = a.cur.label THEN a "
        "ELSE {'done': a.done, 'cur': CASE WHEN b.cur.c > a.cur.c THEN b.cur ELSE a.cur END} END"
    )
    if policy == "longest":
        fold = (
            "CASE WHEN b.cur.s >= a.cur.e THEN {'done': list_append(a.done, a.cur), 'cur': b.cur} "
            "WHEN b.cur.label = a.cur.label AND b.cur.e > a.cur.e THEN {'done': a.done, 'cur': {'s': a.cur.s, 'e': b.cur.e, 'label': a.cur.label, 'c': greatest(a.cur.c, b.cur.c)}} "
            "WHEN b.cur.label <> a.cur.label AND b.cur.e - b.cur.s > a.cur.e - a.cur.s THEN {'done': a.done, 'cur': b.cur} ELSE a END"
        )
    return f"""{name}_raw AS ({' UNION ALL '.join(selects)}),
{name}_at AS (
  SELECT k, t, label, c, v,
    (sum(length(g) + length(w)) OVER (PARTITION BY k, r ORDER BY i))::BIGINT - length(w) + length(b) + length(v) AS e
  FROM {name}_raw WHERE v IS NOT NULL
),
{name}_ok AS (
  SELECT k, t, label, c, e - length(v) AS s, e FROM {name}_at
  WHERE NOT regexp_matches(
      (CASE WHEN e - length(v) > 0 THEN substr(t, e - length(v), 1) ELSE '' END) || substr(t, e + 1, 1), '[\\p{{L}}\\p{{N}}]')
    AND (label <> 'CREDITCARDNUMBER' OR {luhn}) AND (label <> 'IPV4' OR {ipv4})
    AND (label <> 'PASSWORD' OR regexp_matches(v, '[0-9!@#$%]|[a-z][A-Z]')){more and f"""
  UNION ALL {more}"""}
),
{name}_folded AS (
  SELECT k, any_value(t) AS t, list_reduce(
    list({{'done': []::{span}[], 'cur': {{'s': s, 'e': e, 'label': label, 'c': c}}::{span}}} ORDER BY s, e DESC, label, c DESC),
    lambda a, b: {fold}) AS r
  FROM {name}_ok GROUP BY k
),
{name}_flat AS (SELECT k, t, unnest(list_append(r.done, r.cur)) AS x FROM {name}_folded),
{name} AS (
  SELECT k AS {key}, substr(t, x.s + 1, x.e - x.s) AS original, x.label AS label, x.s AS s, x.e AS e, x.c AS c
  FROM {name}_flat
)"""


def with_dummy(name: str, spans: str, salt: str = "") -> str:
    """CTEs ending in ``name``: the columns of ``spans`` plus ``dummy``."""
    return (
        f"{name}_d AS (SELECT *, {dummy_columns('label', 'original', salt)} FROM {spans}), "
        f"{name} AS (SELECT * EXCLUDE (hk, d0, d1, d2, d3, d4, d5), {dummy_value()} AS dummy FROM {name}_d)"
    )


def masked_texts(name: str, spans: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE ``name``(key, masked_text) for all rows of ``source``; ``spans`` has ``dummy``."""
    return f"""{name}_p AS (
  SELECT {key}, dummy, e, s, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS b FROM {spans}
),
{name}_j AS (
  SELECT p.{key}, string_agg(substr(d.{text}, p.b + 1, p.s - p.b) || p.dummy, '' ORDER BY p.s) AS head, max(p.e) AS tail
  FROM {name}_p p JOIN {source} d ON d.{key} = p.{key} GROUP BY p.{key}
),
{name} AS (
  SELECT d.{key}, CASE WHEN j.head IS NULL THEN d.{text} ELSE j.head || substr(d.{text}, j.tail + 1) END AS masked_text
  FROM {source} d LEFT JOIN {name}_j j ON j.{key} = d.{key}
)"""


def synthetic(name: str = "gold", salt: str = "42") -> str:
    """CTEs ending in ``name``_text(doc_id, text) and ``name``(doc_id, original, label, s, e, c): documents and a sentence."""
    key = f"('{salt}' || '|' || doc_id)"
    return f"""{name}_t AS (
  SELECT doc_id, {pick(TEMPLATES, draw(key, 0))} AS tpl FROM documents
),
{name}_u AS (
  SELECT doc_id, unnest(regexp_extract_all(tpl, '\\{{[A-Z]+\\}}')) AS slot, unnest(string_split_regex(tpl, '\\{{[A-Z]+\\}}')) AS gap,
    generate_subscripts(string_split_regex(tpl, '\\{{[A-Z]+\\}}'), 1) AS i
  FROM {name}_t
),
{name}_v AS (
  SELECT doc_id, gap, i, CASE WHEN slot IS NULL THEN NULL ELSE replace(replace(slot, '{{', ''), '}}', '') END AS label,
    doc_id || '#' || (i - 1) AS original FROM {name}_u
),
{name}_w AS (SELECT *, {dummy_columns("coalesce(label, '')", 'original', salt)} FROM {name}_v),
{name}_x AS (SELECT doc_id, gap, i, label, CASE WHEN label IS NULL THEN NULL ELSE {dummy_value()} END AS val FROM {name}_w),
{name}_s AS (SELECT doc_id, string_agg(gap || coalesce(val, ''), '' ORDER BY i) AS sentence FROM {name}_x GROUP BY doc_id),
{name}_text AS (
  SELECT s.doc_id, coalesce(d.text, '') || ' ' || s.sentence AS text FROM {name}_s s JOIN documents d ON d.doc_id = s.doc_id
),
{name} AS (
  SELECT x.doc_id, original, label, e - length(original) + length(coalesce(d.text, '')) + 1 AS s,
    e + length(coalesce(d.text, '')) + 1 AS e, 1.0::DOUBLE AS c
  FROM (
    SELECT doc_id, val AS original, label, (sum(length(gap) + length(val)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e
    FROM {name}_x WHERE label IS NOT NULL) x JOIN documents d ON d.doc_id = x.doc_id
)"""


def second(name: str = "other", gold: str = "gold") -> str:
    """CTE ``name``: the second annotator's entities over the synthetic samples."""
    u = draw("('p|' || doc_id || '|' || s)", 0) + " % 10"
    return f"""{name}_u AS (SELECT *, {u} AS u FROM {gold}),
{name}_c AS (
  SELECT doc_id, s, CASE WHEN u = 2 AND e - s > 1 THEN e - 1 ELSE e END AS e, c,
    CASE WHEN u = 1 THEN CASE WHEN label = 'COMPANYNAME' THEN 'CITY' ELSE 'COMPANYNAME' END
      WHEN u = 3 AND doc_id % 5 = 0 THEN 'NICKNAME' ELSE label END AS label
  FROM {name}_u WHERE u <> 0
  UNION ALL SELECT doc_id, 0 AS s, 4 AS e, 0.5 AS c, 'USERNAME' AS label FROM {gold}_text WHERE doc_id % 7 = 0
),
{name} AS (
  SELECT x.doc_id, substr(t.text, x.s + 1, x.e - x.s) AS original, x.label, x.s, x.e, x.c
  FROM {name}_c x JOIN {gold}_text t ON t.doc_id = x.doc_id
)"""


def language_country(name: str = "lc", salt: str = "42") -> str:
    """CTE ``name``(doc_id, language, country)."""
    key = f"('{salt}' || '|' || doc_id)"
    languages = list(fv.LANGUAGE_COUNTRIES)
    cases = " ".join(
        f"WHEN {quote(k)} THEN {pick(v, 'd')}" for k, v in fv.LANGUAGE_COUNTRIES.items()
    )
    return f"""{name}_l AS (
  SELECT doc_id, {pick(languages, draw(key, 1))} AS language, {draw(key, 2)} AS d FROM documents
),
{name} AS (SELECT doc_id, language, CASE language {cases} END AS country FROM {name}_l)"""


STANDARD = word_list(fv.STANDARD_LABELS)
TOKEN, WORD = quote(prepare.TOKEN), quote(prepare.WORD)
