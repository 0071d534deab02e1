"""Registered queries: detection, masking and restoring of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import running_totals
from pii_spark.functions.spans import ENTITIES, entity, merge_spans, restore_by_span, restore_text
from pii_spark.operators import combine, decode, detect, mask, phrases, prepare
from pii_spark.operators.detect import rule_entities
from pii_spark.plans import oracle_parts as sql
from pii_spark.plans.corpora import detected_documents, documents, samples, table

DOMAINS = ["example.com", "m.example.net"]


def entity_rows(spark, sf):
    rows = detect.explode_entities(detected_documents(spark, sf), "doc_id")
    return rows.select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), "confidence",
    )


def sql_pii_spans(spark, sf):
    """All rules as a table function beside the rows of a view."""
    detect.register_spans(spark)
    documents(spark, sf).createOrReplaceTempView("spans_documents")
    return spark.sql(
        "SELECT d.doc_id, s.value, s.label, CAST(s.start AS BIGINT) AS start, CAST(s.`end` AS BIGINT) AS `end`, s.confidence "
        "FROM spans_documents d, LATERAL pii_spans(d.text) s"
    )


def pii_label_counts(spark, sf):
    rows = detect.explode_entities(detected_documents(spark, sf), "doc_id")
    return rows.groupBy("label").agg(
        F.count("*").alias("entities"), F.countDistinct("doc_id").alias("docs")
    )


def pii_docs_by_lang(spark, sf):
    d = detected_documents(spark, sf)
    return d.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.size("entities") > 0).alias("docs_with_pii"),
        F.sum(F.size("entities")).cast("bigint").alias("entities"),
    )


def detect_threshold(spark, sf):
    d = detect.filter_confidence(detected_documents(spark, sf), 0.93)
    return detect.explode_entities(d, "doc_id").groupBy("label").agg(F.count("*").alias("entities"))


def merge_longest(spark, sf):
    s = samples(spark, sf).select("doc_id", "text")
    d = detect.detect_rules(s, policy="longest")
    return detect.explode_entities(d, "doc_id").select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start")
    )


def synthetic_detection(spark, sf):
    s = detect.detect_rules(samples(spark, sf).select("doc_id", "text"))
    return detect.explode_entities(s, "doc_id").select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start"),
        F.round("confidence", 4).alias("confidence"),
    )


def gazetteer(spark):
    pools = {"FIRSTNAME": fv.FIRST_NAMES, "SURNAME": fv.SURNAMES, "CITY": fv.CITIES}
    rows = [(w, label) for label, words in pools.items() for w in words]
    return spark.createDataFrame(rows, "value string, label string")


def gazetteer_hits(spark, sf):
    hits = detect.detect_dictionary(samples(spark, sf).select("doc_id", "text"), gazetteer(spark))
    return hits.select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start")
    )


PHRASE_POOLS = {
    "FIRSTNAME": fv.FIRST_NAMES, "SURNAME": fv.SURNAMES, "CITY": fv.CITIES, "STREET": fv.STREETS, "STATE": fv.STATES,
    "COUNTRY": fv.COUNTRIES,
}
OPENING = r"^[\p{L}]+ [\p{L}]+ [\p{L}]+"


def phrase_gazetteer(spark, sf):
    """The word pools, and the first three words of every document: a dictionary that grows with the table."""
    rows = [(w, label) for label, words in PHRASE_POOLS.items() for w in words]
    opening = F.regexp_extract("text", OPENING, 0)
    own = table(spark, sf, "documents").select(opening.alias("value"), F.lit("OPENING").alias("label")).where("value <> ''")
    return spark.createDataFrame(rows, "value string, label string").unionByName(own.distinct())


def gazetteer_phrases(spark, sf):
    hits = phrases.detect_phrases(samples(spark, sf).select("doc_id", "text"), phrase_gazetteer(spark, sf))
    return hits.select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
    )


MODEL_WORD = "[a-z]+[0-9]{4}"


def user_names():
    """A stand-in for a model: words that look like user names, some of them inside other entities."""
    import re

    word = re.compile(MODEL_WORD)

    def model(texts):
        return [
            [
                {"text": m.group(), "label": "USERNAME", "start": m.start(), "end": m.end(), "confidence": 0.65}
                for m in word.finditer(t)
            ]
            for t in texts
        ]

    return model


def combined(spark, sf):
    texts = samples(spark, sf).select("doc_id", "text")
    return combine.detect_combined(texts, gazetteer=phrase_gazetteer(spark, sf), load=user_names)


def combined_entities(spark, sf):
    rows = detect.explode_entities(combined(spark, sf), "doc_id")
    return rows.select(
        "doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), F.round("confidence", 4).alias("confidence"),
    )


def masked_combined(spark, sf):
    m = mask.mask_text(combined(spark, sf))
    return m.select(
        "doc_id", F.md5("masked_text").alias("masked_md5"), F.size("entities").cast("bigint").alias("entities"),
        F.col("error").isNull().alias("ok"),
    )


def masked_documents(spark, sf):
    m = mask.mask_text(detected_documents(spark, sf))
    return m.select(
        "doc_id", F.md5("masked_text").alias("masked_md5"),
        F.length("masked_text").cast("bigint").alias("masked_length"),
        F.size("entities").cast("bigint").alias("entities"),
    )


def roundtrip(spark, sf):
    m = mask.mask_text(detected_documents(spark, sf))
    return m.select(
        "doc_id",
        (restore_text(F.col("masked_text"), F.col("masked_to_original")) == F.col("text")).alias("restored"),
        (restore_by_span(F.col("masked_text"), F.col("entities")) == F.col("text")).alias("restored_by_span"),
    )


TAIL = " seen at 10.0.0.1 and 10.0.0.2, then [REDACTED], in "


def restored_collisions(spark, sf):
    """Every document with two addresses without a generator, a placeholder and cities that share draws."""
    cities = fv.CITIES[:40]
    docs = documents(spark, sf).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(TAIL + " ".join(cities))).alias("text"))
    listed = F.expr(f"transform(split('{' '.join(cities)}', ' '), c -> named_struct('text', c, 'n', length(c)))")
    first = F.length("text") - len(" ".join(cities))
    starts = running_totals(F.transform(listed, lambda c: c["n"] + 1))
    named = F.zip_with(listed, starts, lambda c, end: entity(c["text"], F.lit("CITY"), first + end - c["n"] - 1, first + end - 1, F.lit(0.9)))
    both = docs.withColumn("entities", merge_spans(F.concat(rule_entities(F.col("text")), named.cast(ENTITIES))))
    m = mask.mask_exact(both)
    return m.select(
        "doc_id",
        (restore_text(F.col("masked_text"), F.col("masked_to_original")) == F.col("text")).alias("restored"),
        (restore_by_span(F.col("masked_text"), F.col("entities")) == F.col("text")).alias("restored_by_span"),
        F.size("entities").cast("bigint").alias("entities"),
        F.size(F.array_distinct(F.transform("entities", lambda e: e["text"]))).cast("bigint").alias("originals"),
        F.size("masked_to_original").cast("bigint").alias("dummies"),
        F.exists("entities", lambda e: F.contains(F.col("masked_text"), e["text"]) & (e["label"] == "IPV4")).alias("leaks"),
    )


def pii_check(spark, sf):
    c = mask.pii_check(documents(spark, sf).select("doc_id", "text"))
    return c.select(
        "doc_id", F.md5("masked_message").alias("message_md5"), "pii_found",
        F.size("entities").cast("bigint").alias("mapped"),
        F.array_join(F.transform("detected_entities", lambda e: F.concat(e["label"], F.lit(":"), e["original"])), ",").alias("detected"),
    )


def pii_details(spark, sf):
    d = mask.pii_details(mask.mask_text(samples(spark, sf).select("doc_id", "text", "entities")))
    return (
        d.select("doc_id", F.explode_outer("pii_details").alias("d")).where(F.col("d").isNotNull())
        .select("doc_id", F.col("d.text").alias("value"), "d.label", "d.masked_text",
                F.col("d.start_pos").cast("bigint").alias("start_pos"))
    )


def entities_in_response(spark, sf):
    m = mask.mask_text(samples(spark, sf).select("doc_id", "text", "entities"))
    half = F.substring("masked_text", F.lit(1), (F.length("masked_text") / 2).cast("int"))
    r = mask.entities_in_response(m.withColumn("response", half))
    return r.select("doc_id", F.size("used_entities").cast("bigint").alias("used"),
                    F.size("entities").cast("bigint").alias("entities"))


def average_confidence(spark, sf):
    d = mask.add_average_confidence(detected_documents(spark, sf))
    return d.select("doc_id", F.round("average_confidence", 6).alias("average_confidence"))


def pii_coverage(spark, sf):
    c = mask.pii_coverage(detected_documents(spark, sf))
    return c.select("doc_id", F.col("covered").cast("bigint").alias("covered"), F.round("share", 6).alias("share"))


def token_stats(spark, sf):
    t = prepare.tokenize_offsets(documents(spark, sf))
    return t.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(F.transform("tokens", lambda x: F.concat_ws(":", x["text"], x["start"].cast("string"))), " ")).alias("digest"),
    )


def chunks(spark, sf):
    t = prepare.tokenize_offsets(documents(spark, sf))
    c = decode.chunk_tokens(t)
    return c.select(
        "doc_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"),
        F.col("first_token").cast("bigint").alias("first_token"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.col("shift").cast("bigint").alias("shift"),
    )


def host_matches(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    host = F.call_function("try_parse_url", F.col("url"), F.lit("HOST"))
    return p.select("page_id", host.alias("host"), detect.host_matches(host, DOMAINS).alias("matched"))


QUERIES = {
    "pii_entities": entity_rows,
    "sql_pii_spans": sql_pii_spans,
    "pii_label_counts": pii_label_counts,
    "pii_docs_by_lang": pii_docs_by_lang,
    "detect_threshold": detect_threshold,
    "synthetic_detection": synthetic_detection,
    "merge_longest": merge_longest,
    "gazetteer_hits": gazetteer_hits,
    "gazetteer_phrases": gazetteer_phrases,
    "combined_entities": combined_entities,
    "masked_combined": masked_combined,
    "masked_documents": masked_documents,
    "roundtrip": roundtrip,
    "restored_collisions": restored_collisions,
    "pii_check": pii_check,
    "pii_details": pii_details,
    "entities_in_response": entities_in_response,
    "average_confidence": average_confidence,
    "pii_coverage": pii_coverage,
    "token_stats": token_stats,
    "chunks": chunks,
    "host_matches": host_matches,
}


def oracles() -> dict[str, str]:
    spans = sql.rule_spans("spans", "documents")
    dummies = sql.with_dummy("d", "spans")
    gold = sql.synthetic()
    gaz = " UNION ALL ".join(
        f"SELECT unnest({sql.word_list(pool)}) AS w, '{label}' AS label"
        for label, pool in (("FIRSTNAME", fv.FIRST_NAMES), ("SURNAME", fv.SURNAMES), ("CITY", fv.CITIES))
    )
    word = r"[\p{L}\p{N}_'']+"
    token = prepare.TOKEN
    listed = " UNION ALL ".join(
        f"SELECT unnest({sql.word_list(pool)}) AS value, '{label}' AS label" for label, pool in PHRASE_POOLS.items()
    )
    match = "STRUCT(s BIGINT, e BIGINT, label VARCHAR, v VARCHAR)"
    found_phrases = f"""entry AS (
  SELECT value, label, regexp_extract_all(value, '{word}') AS ws,
    list_transform(string_split_regex(value, '{word}'), lambda g: regexp_replace(g, '\\s+', ' ', 'g')) AS gs
  FROM (SELECT DISTINCT * FROM ({listed} UNION ALL
    SELECT regexp_extract(text, '{OPENING}'), 'OPENING' FROM documents)) WHERE value <> ''
), tk AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS v, unnest(string_split_regex(text, '{word}')) AS g,
    generate_subscripts(string_split_regex(text, '{word}'), 1) AS i FROM gold_text
), pos AS (
  SELECT doc_id, i, v, g, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM tk WHERE v IS NOT NULL
), lists AS (
  SELECT doc_id, list(v ORDER BY i) AS vs, list(e ORDER BY i) AS es, list(regexp_replace(g, '\\s+', ' ', 'g') ORDER BY i) AS gs
  FROM pos GROUP BY doc_id
), hit AS (
  SELECT p.doc_id, p.e - length(p.v) AS s, l.es[p.i + len(n.ws) - 1] AS e, n.label
  FROM pos p JOIN entry n ON n.ws[1] = p.v JOIN lists l ON l.doc_id = p.doc_id
  WHERE l.vs[p.i : p.i + len(n.ws) - 1] = n.ws AND l.gs[p.i + 1 : p.i + len(n.ws) - 1] = n.gs[2 : len(n.ws)]
), hits AS (
  SELECT h.*, substr(t.text, s + 1, e - s) AS v FROM hit h JOIN gold_text t ON t.doc_id = h.doc_id
), sweep AS (
  SELECT doc_id, list_reduce(
    list({{'kept': []::{match}[], 'm': {{'s': s, 'e': e, 'label': label, 'v': v}}::{match}}} ORDER BY s, e DESC, label),
    lambda a, b: CASE WHEN b.m.s >= a.m.e OR (b.m.s = a.m.s AND b.m.e = a.m.e) THEN {{'kept': list_append(a.kept, a.m), 'm': b.m}}
      ELSE a END) AS r FROM hits GROUP BY doc_id
), phrase AS (SELECT doc_id, x.v AS v, x.label AS label, x.s AS s, x.e AS e FROM (
  SELECT doc_id, unnest(list_append(r.kept, r.m)) AS x FROM sweep))"""
    modelled = f"""md AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{MODEL_WORD}')) AS v, unnest(string_split_regex(text, '{MODEL_WORD}')) AS g,
    generate_subscripts(string_split_regex(text, '{MODEL_WORD}'), 1) AS i FROM gold_text
), model AS (
  SELECT doc_id, v, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM md WHERE v IS NOT NULL
)"""
    more = """SELECT p.doc_id, t.text, label, 0.6::DOUBLE, s, e FROM phrase p JOIN gold_text t ON t.doc_id = p.doc_id
  UNION ALL SELECT m.doc_id, t.text, 'USERNAME', 0.65::DOUBLE, e - length(v), e FROM model m JOIN gold_text t ON t.doc_id = m.doc_id"""
    every = f"WITH {gold}, {found_phrases}, {modelled}, {sql.rule_spans('every', 'gold_text', more=more)}"
    masked = f"WITH {spans}, {dummies}, {sql.masked_texts('m', 'd', 'documents')} "
    tokens = f"""WITH tk AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{token}')) AS v, unnest(string_split_regex(text, '{token}')) AS g,
    generate_subscripts(string_split_regex(text, '{token}'), 1) AS i FROM documents
), pos AS (
  SELECT doc_id, v, i, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(v) AS s
  FROM tk WHERE v IS NOT NULL
) """
    in_order = f"""lst AS (
  SELECT doc_id, list({{'o': original, 'd': dummy}} ORDER BY s) AS xs FROM d GROUP BY doc_id
)"""
    return {
        "pii_entities": f"WITH {spans} SELECT doc_id, original AS value, label, s AS start, e AS \"end\", c AS confidence FROM spans",
        "sql_pii_spans": f"""WITH {sql.rule_spans('spans', 'documents', rules=detect.ALL_RULES)}
SELECT doc_id, original AS value, label, s AS start, e AS "end", c AS confidence FROM spans""",
        "pii_label_counts": f"WITH {spans} SELECT label, count(*) AS entities, count(DISTINCT doc_id) AS docs FROM spans GROUP BY label",
        "pii_docs_by_lang": f"""WITH {spans}, n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT lang, count(*) AS docs, count(n.n) AS docs_with_pii, coalesce(sum(n.n), 0)::BIGINT AS entities
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY lang""",
        "detect_threshold": f"WITH {spans} SELECT label, count(*) AS entities FROM spans WHERE c >= 0.93 GROUP BY label",
        "synthetic_detection": f"""WITH {gold}, {sql.rule_spans('spans', 'gold_text')}
SELECT doc_id, original AS value, label, s AS start, round(c, 4) AS confidence FROM spans""",
        "merge_longest": f"""WITH {gold}, {sql.rule_spans('spans', 'gold_text', policy='longest')}
SELECT doc_id, original AS value, label, s AS start FROM spans""",
        "gazetteer_hits": f"""WITH {gold}, gaz AS ({gaz}), tk AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS v, unnest(string_split_regex(text, '{word}')) AS g,
    generate_subscripts(string_split_regex(text, '{word}'), 1) AS i FROM gold_text
), pos AS (
  SELECT doc_id, v, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(v) AS s
  FROM tk WHERE v IS NOT NULL
) SELECT doc_id, v AS value, label, s AS start FROM pos JOIN gaz ON gaz.w = pos.v""",
        "gazetteer_phrases": f"""WITH {gold}, {found_phrases}
SELECT doc_id, v AS value, label, s AS start, e AS "end" FROM phrase""",
        "combined_entities": f"""{every}
SELECT doc_id, original AS value, label, s AS start, e AS "end", round(c, 4) AS confidence FROM every""",
        "masked_combined": f"""{every}, {sql.with_dummy('d', 'every')}, {sql.masked_texts('m', 'd', 'gold_text')},
n AS (SELECT doc_id, count(*) AS n FROM every GROUP BY doc_id)
SELECT m.doc_id, md5(masked_text) AS masked_md5, coalesce(n.n, 0)::BIGINT AS entities, true AS ok
FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
        "masked_documents": masked + """, n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT m.doc_id, md5(masked_text) AS masked_md5, length(masked_text)::BIGINT AS masked_length, coalesce(n.n, 0)::BIGINT AS entities
FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
        "roundtrip": masked + f""", {in_order}, uniq AS (
  SELECT doc_id, list_filter(xs, lambda x, i: len(list_filter(xs[1:i-1], lambda y: y.d = x.d)) = 0) AS xs FROM lst
), pairs AS (SELECT doc_id, unnest(xs) AS x FROM uniq),
sorted AS (SELECT doc_id, list({{'t': '', 'd': x.d, 'o': x.o}} ORDER BY length(x.d) DESC, x.d) AS xs FROM pairs GROUP BY doc_id),
back AS (
  SELECT m.doc_id, CASE WHEN s.xs IS NULL THEN m.masked_text ELSE list_reduce(
    list_prepend({{'t': m.masked_text, 'd': '', 'o': ''}}, s.xs),
    lambda a, b: {{'t': replace(a.t, b.d, b.o), 'd': '', 'o': ''}}).t END AS r
  FROM m LEFT JOIN sorted s ON s.doc_id = m.doc_id
) SELECT b.doc_id, b.r = t.text AS restored, true AS restored_by_span FROM back b JOIN documents t ON t.doc_id = b.doc_id""",
        "restored_collisions": f"""WITH longer AS (
  SELECT doc_id, coalesce(text, '') || '{TAIL + ' '.join(fv.CITIES[:40])}' AS text FROM documents
), city AS (
  SELECT unnest({sql.word_list(fv.CITIES[:40])}) AS v, generate_subscripts({sql.word_list(fv.CITIES[:40])}, 1) AS i
), spot AS (
  SELECT v, (sum(length(v) + 1) OVER (ORDER BY i))::BIGINT - 1 AS e FROM city
), {sql.rule_spans('every', 'longer', more=f"""SELECT doc_id, text, 'CITY', 0.9::DOUBLE,
  length(text) - {len(' '.join(fv.CITIES[:40]))} + e - length(v), length(text) - {len(' '.join(fv.CITIES[:40]))} + e FROM longer, spot""")}
SELECT doc_id, true AS restored, true AS restored_by_span, count(*) AS entities, count(DISTINCT original) AS originals,
  count(DISTINCT (label, original)) AS dummies, false AS leaks FROM every GROUP BY doc_id""",
        "pii_check": masked + """, n AS (
  SELECT doc_id, count(DISTINCT dummy) AS n, string_agg(label || ':' || original, ',' ORDER BY s) AS detected FROM d GROUP BY doc_id
) SELECT m.doc_id, md5(masked_text) AS message_md5, n.n IS NOT NULL AS pii_found, coalesce(n.n, 0)::BIGINT AS mapped,
  coalesce(n.detected, '') AS detected FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
        "pii_details": f"""WITH {gold}, {sql.with_dummy('d', 'gold')}, firsts AS (
  SELECT doc_id, dummy, first(original ORDER BY s) AS original FROM d GROUP BY doc_id, dummy
), back AS (
  SELECT doc_id, original, first(dummy ORDER BY length(dummy) DESC, dummy) AS dummy FROM firsts GROUP BY doc_id, original
) SELECT d.doc_id, d.original AS value, d.label, coalesce(b.dummy, '') AS masked_text, d.s AS start_pos
FROM d LEFT JOIN back b ON b.doc_id = d.doc_id AND b.original = d.original WHERE length(d.original) > 2""",
        "entities_in_response": f"""WITH {gold}, {sql.with_dummy('d', 'gold')}, {sql.masked_texts('m', 'd', 'gold_text')},
r AS (SELECT doc_id, substr(masked_text, 1, length(masked_text) // 2) AS response FROM m)
SELECT d.doc_id, count_if(contains(r.response, d.dummy))::BIGINT AS used, count(*) AS entities
FROM d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
        "average_confidence": f"""WITH {spans}, a AS (SELECT doc_id, avg(c) AS c FROM spans GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(a.c, 0), 6) AS average_confidence FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
        "pii_coverage": f"""WITH {spans}, vals AS (SELECT DISTINCT doc_id, original FROM spans), hits AS (
  SELECT v.doc_id, original, unnest(range(1, length(d.text)::BIGINT + 1)) AS p, d.text
  FROM vals v JOIN documents d ON d.doc_id = v.doc_id
), occ AS (SELECT doc_id, p, p + length(original) AS q FROM hits WHERE substr(text, p, length(original)) = original),
cells AS (SELECT DISTINCT doc_id, unnest(range(p, q)) AS c FROM occ),
n AS (SELECT doc_id, count(*) AS n FROM cells GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS covered,
  round(CASE WHEN length(d.text) > 0 THEN coalesce(n.n, 0)::DOUBLE / length(d.text) ELSE 0 END, 6) AS share
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
        "token_stats": tokens + """, a AS (SELECT doc_id, count(*) AS n, md5(string_agg(v || ':' || s, ' ' ORDER BY i)) AS h FROM pos GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(h, md5('')) AS digest FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
        "chunks": tokens + """, n AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
alln AS (SELECT d.doc_id, coalesce(n.n, 0) AS n FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id),
st AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 448)) AS f FROM alln)
SELECT st.doc_id, f // 448 AS chunk_ix, f AS first_token, least(n - f, 512)::BIGINT AS n_tokens, coalesce(p.s, 0)::BIGINT AS shift
FROM st LEFT JOIN pos p ON p.doc_id = st.doc_id AND p.i = f + 1 WHERE f = 0 OR f - 448 + 512 < n""",
        "host_matches": r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, host, lower(host) IN ('example.com', 'm.example.net') OR lower(host) LIKE '%.example.com' OR lower(host) LIKE '%.m.example.net' AS matched FROM h""",
    }
