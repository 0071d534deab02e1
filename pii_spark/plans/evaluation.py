"""Registered queries: span metrics, decoding of stored scores, annotation review."""

from __future__ import annotations

from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.dummies import hash_draw
from pii_spark.functions.spans import replace_spans, with_dummies
from pii_spark.operators import decode, detect, evaluate, prepare, review
from pii_spark.plans import oracle_parts as sql
from pii_spark.plans.corpora import (
    both_annotations, detected_documents, documents, file_name, mask_of, privacy_mask, samples, second_annotation, table,
)

DECODED = ["EMAIL", "PHONENUMBER", "CREDITCARDNUMBER", "SECURITYTOKEN", "IPV4"]
TAGS = ["O"] + [f"{p}-{x}" for x in DECODED for p in "BI"]


def _pairs(spark, sf):
    gold = samples(spark, sf)
    return evaluate.pair_spans(gold, second_annotation(gold))


def _draw(tag: str, n: int):
    return hash_draw(F.concat_ws("|", F.lit(tag), F.col("doc_id").cast("string")), 0) % n


def span_prf(spark, sf):
    return evaluate.add_prf(evaluate.span_confusion(_pairs(spark, sf)))


def span_micro_macro(spark, sf):
    return evaluate.micro_macro(evaluate.span_confusion(_pairs(spark, sf)))


def worst_labels(spark, sf):
    return evaluate.worst_labels(evaluate.span_confusion(_pairs(spark, sf)), 5).select("label", "f1")


def rule_prf(spark, sf):
    """The rule detector measured on the synthetic gold."""
    gold = samples(spark, sf)
    found = detect.detect_rules(gold.select("doc_id", "text"), detect.ALL_RULES)
    return evaluate.add_prf(evaluate.span_confusion(evaluate.pair_spans(gold, found)))


def relaxed_prf(spark, sf):
    return evaluate.add_prf(evaluate.relaxed_confusion(_pairs(spark, sf)))


def explain_sample(spark, sf):
    rows = evaluate.explain_sample(_pairs(spark, sf), samples(spark, sf))
    return rows.select("doc_id", "side", F.col("start").cast("bigint").alias("start"), "label", "marker", "span_text")


def latency_percentiles(spark, sf):
    return evaluate.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"])


def latency_overall(spark, sf):
    return evaluate.latency_percentiles(table(spark, sf, "events").select("value"), "value")


STATUS = {"view": 200, "click": 201, "purchase": 404, "signup": 500}


def status_buckets(spark, sf):
    code = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    events = table(spark, sf, "events").select(F.try_element_at(code, F.col("event_type")).alias("status"))
    return evaluate.status_buckets(events)


def roundtrip_rates(spark, sf):
    s = samples(spark, sf).select("doc_id", "text", with_dummies(F.col("entities")).alias("e"))
    rows = s.select(
        F.when(_draw("st", 10) == 0, 500).when(_draw("st", 10) == 1, F.lit(None)).otherwise(200).alias("status"),
        F.transform("e", lambda x: x["dummy"]).alias("dummies"),
        F.when(_draw("leak", 4) == 0, replace_spans(F.col("text"), F.col("e"))).otherwise("fine").alias("answer"),
    )
    return evaluate.roundtrip_rates(rows)


def tag_metrics(spark, sf):
    both = both_annotations(spark, sf).select("text", mask_of("gold").alias("own"), mask_of("entities").alias("other"))
    tagged = prepare.align_bio(both, mask="own", tags="gold_tags")
    return evaluate.tag_metrics(prepare.align_bio(tagged, mask="other", tags="predicted_tags", tokens="tokens"))


def decoder_parity(spark, sf):
    gold = samples(spark, sf)
    p = evaluate.decoder_parity(gold, second_annotation(gold))
    return p.select("doc_id", "equal", F.col("only_left").cast("bigint").alias("only_left"), F.col("only_right").cast("bigint").alias("only_right"))


def logit_diff(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("a"),
        F.transform("embedding", lambda x: x.cast("double") * 1.25).alias("b"))
    d = evaluate.logit_diff(e)
    return d.select("vec_id", "same_argmax", F.round("max_diff", 6).alias("max_diff"), F.round("mean_diff", 6).alias("mean_diff"), "close")


def topk_labels(spark, sf):
    names = [f"L{i}" for i in range(64)]
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(decode.top_labels(F.col("embedding"), names, 3)).alias("pos", "t"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "t.label", F.round("t.probability", 6).alias("probability"))


def smoke_labels(spark, sf):
    both = both_annotations(spark, sf).select(
        "doc_id", F.array_distinct(F.transform("gold", lambda e: e["label"])).alias("expected"),
        F.transform("entities", lambda e: e["label"]).alias("detected"),
    )
    s = evaluate.smoke_labels(both)
    return s.select("doc_id", "passed", F.array_join("missing", ",").alias("missing"))


def score_chunks(spark, sf, change=None):
    """Chunk rows of the documents with scores that favour the rule detector's tags, or ``change`` of them."""
    spans = prepare.align_bio(privacy_mask(detected_documents(spark, sf))).select("doc_id", "text", "tokens", "tags")
    if change is not None:
        spans = spans.withColumn("tags", F.expr(change))
    pieces = decode.chunk_tokens(spans, parallel=("tags",))
    names = F.array(*[F.lit(t) for t in TAGS])
    rows = [[8.0 if i == j else 0.0 for j in range(len(TAGS))] for i in range(len(TAGS))]
    table_of_scores = F.from_json(F.lit(str(rows)), "array<array<float>>")

    def scores(tag):
        return F.get(table_of_scores, (F.array_position(names, tag) - 1).cast("int"))

    return pieces.withColumn("logits", F.flatten(F.transform("tags", scores))).drop("tags")


#: Joiners inside an entity lose their tag, as a model leaves them; decoding bridges them.
_NO_JOINERS = (
    "transform(tags, (t, i) -> CASE WHEN t LIKE 'I-%' AND get(tags, i + 1) = t AND "
    f"translate(get(tokens, i).text, '{fv.JOINER_CHARS}', '') = '' THEN 'O' ELSE t END)"
)

#: A mark right behind an entity, ahead of a blank or the end, is tagged as its part; trimming drops it.
_WITH_MARKS = (
    "transform(tags, (t, i) -> CASE WHEN t = 'O' AND get(tags, i - 1) <> 'O' AND get(tokens, i).start = get(tokens, i - 1).`end` "
    "AND get(tokens, i).text IN (',', '.', ';', ':', '!', '?') AND get(tokens, i - 1).text NOT IN (',', '.', ';', ':', '!', '?') "
    "AND substring(text, get(tokens, i).`end` + 1, 1) IN ('', ' ', '\\t', '\\n', '\\r') "
    "THEN concat('I-', substring(get(tags, i - 1), 3)) ELSE t END)"
)


def _crf():
    n = len(TAGS)
    transitions = [[0.0] * n for _ in range(n)]
    for j, tag in enumerate(TAGS):
        if tag.startswith("I-"):
            transitions[0][j] = -4.0
    return {"transitions": transitions, "start": [0.0] * n, "end": [0.0] * n}


def _decoded(spark, sf, crf, change=None):
    d = decode.decode_spans(score_chunks(spark, sf, change), TAGS, crf)
    rows = detect.explode_entities(d, "doc_id")
    return rows.select("doc_id", F.col("text").alias("value"), "label", F.col("start").cast("bigint").alias("start"), F.round("confidence", 4).alias("confidence"))


def decode_spans(spark, sf):
    return _decoded(spark, sf, _crf())


def decode_argmax(spark, sf):
    return _decoded(spark, sf, None)


def decode_bridged(spark, sf):
    return _decoded(spark, sf, None, _NO_JOINERS)


def decode_trimmed(spark, sf):
    return _decoded(spark, sf, None, _WITH_MARKS)


def detect_with_model(spark, sf):
    """The model hook, with a small stand-in model that finds e-mail-like words."""

    def load():
        import re

        pattern = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")

        def model(texts):
            return [[{"text": m.group(), "label": "EMAIL", "start": m.start(), "end": m.end(), "confidence": 1.0}
                     for m in pattern.finditer(t)] for t in texts]

        return model

    d = detect.detect_with_model(documents(spark, sf), load)
    return d.select("doc_id", F.size("entities").cast("bigint").alias("n"), F.col("error").isNull().alias("ok"))


# -- review ----------------------------------------------------------------------------------------

def _masks(spark, sf):
    gold = samples(spark, sf)
    own = privacy_mask(gold).withColumn("file_name", file_name(F.col("doc_id")))
    other = privacy_mask(second_annotation(gold)).withColumn("file_name", file_name(F.col("doc_id")))
    return own, other


def _reviews(spark, sf):
    return review.diff_annotations(*_masks(spark, sf))


def annotation_diff(spark, sf):
    return review.explode_issues(_reviews(spark, sf))


def audit_counts(spark, sf):
    return review.audit_counts(_reviews(spark, sf))


def issue_breakdown(spark, sf):
    return review.issue_breakdown(review.explode_issues(_reviews(spark, sf)))


def noisiest_files(spark, sf):
    n = review.noisiest_files(_reviews(spark, sf))
    return n.select("file_name", *[F.col(c).cast("bigint").alias(c) for c in ("issue_count", "wrong_label", "extra", "missing")])


def example_issues(spark, sf):
    return review.example_issues(_reviews(spark, sf)).select("file_name", "issue_type", F.col("pos").cast("bigint").alias("pos"))


def corrected_samples(spark, sf):
    own, other = _masks(spark, sf)
    c = review.corrected_samples(_reviews(spark, sf), other, own)
    shown = F.transform("entries", lambda e: F.concat_ws(":", e["id"], e["start"].cast("string"), e["text"], e["label"]))
    return c.select("file_name", F.array_join(shown, ";").alias("entries"))


def _has(label):
    return F.exists("privacy_mask", lambda e: e["label"] == label)


def _ledgers(spark, sf):
    """An older ledger of the files that name a city, and a newer one of those that name a person."""
    own, other = _masks(spark, sf)
    older = review.ledger_rows(review.diff_annotations(other.where(_has("CITY")), own.where(_has("CITY"))))
    people = own.where(_has("SURNAME"))
    newer = review.ledger_rows(review.diff_annotations(people, other.join(people.select("file_name"), "file_name", "left_semi")))
    return older, newer


def ledger_merge(spark, sf):
    m = review.merge_ledger(*_ledgers(spark, sf))
    return m.select("file_name", "status", F.col("issue_count").cast("bigint").alias("issue_count"))


def ledger_rows(spark, sf):
    rows = review.ledger_rows(_reviews(spark, sf))
    return rows.select("file_name", "status", F.col("issue_count").cast("bigint").alias("issue_count"), F.md5("issues").alias("issues_md5"))


def unreviewed(spark, sf):
    own, _ = _masks(spark, sf)
    return review.skip_reviewed(own.select("file_name"), _ledgers(spark, sf)[1])


def filter_by_ledger(spark, sf):
    own, _ = _masks(spark, sf)
    rows = review.ledger_rows(_reviews(spark, sf))
    return prepare.filter_by_ledger(own.select("file_name", "doc_id"), rows)


QUERIES = {
    f.__name__: f
    for f in (
        span_prf, span_micro_macro, worst_labels, rule_prf, relaxed_prf, explain_sample, latency_percentiles,
        latency_overall, status_buckets, roundtrip_rates, tag_metrics, decoder_parity, logit_diff, topk_labels,
        smoke_labels, decode_spans, decode_argmax, decode_bridged, decode_trimmed, detect_with_model, annotation_diff, audit_counts,
        issue_breakdown, noisiest_files, example_issues, corrected_samples, ledger_merge, ledger_rows,
        unreviewed, filter_by_ledger,
    )
}


def oracles() -> dict[str, str]:
    gold, other = sql.synthetic(), sql.second()
    std = f"list_contains({sql.STANDARD}, label)"

    def prf(digits: int | None = 4) -> str:
        p = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
        r = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
        return f"""pr AS (SELECT *, ({p})::DOUBLE AS p, ({r})::DOUBLE AS r FROM cf),
sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)"""

    def confusion(predicted: str) -> str:
        return f"""g AS (SELECT DISTINCT doc_id, s, e, label FROM gold), q AS (SELECT DISTINCT doc_id, s, e, label FROM {predicted}),
cmp AS (SELECT coalesce(g.doc_id, q.doc_id) AS doc_id, coalesce(g.s, q.s) AS s, coalesce(g.e, q.e) AS e, coalesce(g.label, q.label) AS label,
  g.doc_id IS NOT NULL AS ig, q.doc_id IS NOT NULL AS iq FROM g FULL JOIN q ON g.doc_id = q.doc_id AND g.s = q.s AND g.e = q.e AND g.label = q.label),
cf AS (SELECT label, count_if(ig AND iq)::BIGINT AS tp, count_if(iq AND NOT ig)::BIGINT AS fp, count_if(ig AND NOT iq)::BIGINT AS fn FROM cmp GROUP BY label)"""

    prf_cols = "SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM sc"
    cmp_ = f"WITH {gold}, {other}, {confusion('other')}, {prf()}"

    relaxed = f"""WITH {gold}, {other}, {confusion('other')},
gi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label) AS i FROM g),
qi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label) AS j FROM q),
c0 AS (SELECT gi.doc_id, gi.i, qi.j, gi.label, least(gi.e, qi.e) - greatest(gi.s, qi.s) AS o FROM gi JOIN qi
  ON gi.doc_id = qi.doc_id AND gi.label = qi.label AND gi.s < qi.e AND qi.s < gi.e)"""
    for n in range(4):
        relaxed += f""", m{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY o DESC, i DESC, j DESC) AS a,
  row_number() OVER (PARTITION BY doc_id, j ORDER BY o DESC, i DESC, j DESC) AS b FROM c{n}) WHERE a = 1 AND b = 1),
c{n + 1} AS (SELECT * FROM c{n} c WHERE NOT EXISTS (SELECT 1 FROM m{n} m WHERE m.doc_id = c.doc_id AND (m.i = c.i OR m.j = c.j)))"""
    pr = prf().replace("cf)", "rcf)", 1).replace("FROM cf", "FROM rcf", 1)
    relaxed += f""", hit AS ({' UNION ALL '.join(f'SELECT doc_id, i, j, label FROM m{n}' for n in range(4))}),
rows AS (SELECT label, 'tp' AS o FROM hit
  UNION ALL SELECT label, 'fn' FROM gi WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = gi.doc_id AND h.i = gi.i)
  UNION ALL SELECT label, 'fp' FROM qi WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = qi.doc_id AND h.j = qi.j)),
rcf AS (SELECT label, count_if(o = 'tp')::BIGINT AS tp, count_if(o = 'fp')::BIGINT AS fp, count_if(o = 'fn')::BIGINT AS fn FROM rows GROUP BY label), {pr} {prf_cols}"""

    quant = ", ".join(f"round(quantile_cont(value, {f}), 2) AS {n}" for f, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))

    def tags(prefix: str, mask: str) -> str:
        return f"""{prefix}cand AS (
  SELECT p.doc_id, p.i, m.s, m.e, m.label, row_number() OVER (PARTITION BY p.doc_id, p.i
    ORDER BY least(p.ts + length(p.v), m.e) - greatest(p.ts, m.s) DESC, m.s, m.e, m.label) AS rn
  FROM pos p JOIN {mask} m ON m.doc_id = p.doc_id AND p.ts < m.e AND m.s < p.ts + length(p.v)
), {prefix}best AS (SELECT p.doc_id, p.i, c.s, c.e, c.label FROM pos p LEFT JOIN {prefix}cand c ON c.doc_id = p.doc_id AND c.i = p.i AND c.rn = 1),
{prefix}b AS (SELECT *, label IS NOT NULL AND NOT coalesce(lag(s) OVER w = s AND lag(e) OVER w = e AND lag(label) OVER w = label, false) AS st
  FROM {prefix}best WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{prefix}n AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM {prefix}b WHERE label IS NOT NULL),
{prefix} AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e, any_value(label) AS label FROM {prefix}n GROUP BY doc_id, grp)"""

    sp = "STRUCT(s BIGINT, e BIGINT, label VARCHAR)"
    greedy = f"""keptl AS (
  SELECT doc_id, list_reduce(list({{'k': [{{'s': s, 'e': e, 'label': label}}::{sp}]}} ORDER BY e - s DESC, s, label),
    lambda a, b: CASE WHEN len(list_filter(a.k, lambda y: b.k[1].s < y.e AND y.s < b.k[1].e)) > 0 THEN a ELSE {{'k': list_concat(a.k, b.k)}} END) AS r
  FROM other GROUP BY doc_id
), kept AS (SELECT doc_id, x.s AS s, x.e AS e, x.label AS label FROM (SELECT doc_id, unnest(r.k) AS x FROM keptl))"""
    seq = f"""WITH {gold}, {other}, {greedy}, tk AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {sql.TOKEN})) AS v, unnest(string_split_regex(text, {sql.TOKEN})) AS g,
    generate_subscripts(string_split_regex(text, {sql.TOKEN}), 1) AS i FROM gold_text
), pos AS (SELECT doc_id, v, i, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(v) AS ts FROM tk WHERE v IS NOT NULL),
{tags('ga', 'gold')}, {tags('pa', 'kept')},
cmp AS (SELECT coalesce(a.label, b.label) AS label, a.doc_id IS NOT NULL AS ig, b.doc_id IS NOT NULL AS iq
  FROM ga a FULL JOIN pa b ON a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e AND a.label = b.label),
cf AS (SELECT label, count_if(ig AND iq)::BIGINT AS tp, count_if(iq AND NOT ig)::BIGINT AS fp, count_if(ig AND NOT iq)::BIGINT AS fn FROM cmp GROUP BY label),
{prf()}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cf), mi AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS n FROM t)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, tp + fn AS support FROM sc
UNION ALL SELECT 'micro avg', round(p, 4), round(r, 4), round(2 * p * r / (p + r), 4), n::BIGINT FROM mi
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(tp + fn)::BIGINT FROM sc
UNION ALL SELECT 'weighted avg', round(sum(p * (tp + fn)) / sum(tp + fn), 4), round(sum(r * (tp + fn)) / sum(tp + fn), 4), round(sum(f * (tp + fn)) / sum(tp + fn), 4), sum(tp + fn)::BIGINT FROM sc"""

    codes = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items())
    st, leak = sql.draw("('st|' || doc_id)", 0) + " % 10", sql.draw("('leak|' || doc_id)", 0) + " % 4"

    def diff(own: str, their: str, pre: str = "") -> str:
        """CTE iss(doc_id, issue_type, value, original_label, suggested_label, ord)."""
        first = f"(SELECT first(label ORDER BY (c = 0.5), s) FROM {their} b WHERE b.doc_id = a.doc_id AND trim(b.original) = trim(a.original))"
        return f"""{pre}iss AS (
  SELECT a.doc_id, CASE WHEN {first} IS NULL THEN 'EXTRA' ELSE 'WRONG_LABEL' END AS issue_type, trim(a.original) AS value, a.label AS original_label,
    {first} AS suggested_label, 0 AS side, (a.c = 0.5) AS late, a.s FROM {own} a
  WHERE NOT EXISTS (SELECT 1 FROM {their} b WHERE b.doc_id = a.doc_id AND trim(b.original) = trim(a.original) AND b.label = a.label)
  UNION ALL SELECT b.doc_id, 'MISSING', trim(b.original), NULL, b.label, 1, (b.c = 0.5), b.s FROM {their} b
  WHERE NOT EXISTS (SELECT 1 FROM {own} a WHERE a.doc_id = b.doc_id AND trim(a.original) = trim(b.original))
), {pre}det AS (SELECT *, 'doc_' || doc_id || '.json' AS file_name, '"' || value || '"' || CASE issue_type
    WHEN 'WRONG_LABEL' THEN ': labeled ' || original_label || ', second annotator suggests ' || suggested_label
    WHEN 'EXTRA' THEN ' (' || original_label || '): only in the first annotation' ELSE ' (' || suggested_label || '): only in the second annotation' END AS detail,
  row_number() OVER (PARTITION BY doc_id ORDER BY side, late, s) - 1 AS pos FROM {pre}iss),
{pre}cnt AS (SELECT doc_id, count(*) AS n FROM {pre}iss GROUP BY doc_id)"""

    rev = f"WITH {gold}, {other}, {diff('gold', 'other')}"
    files = f"{rev}, fl AS (SELECT t.doc_id, 'doc_' || t.doc_id || '.json' AS file_name, coalesce(c.n, 0)::BIGINT AS n FROM gold_text t LEFT JOIN cnt c ON c.doc_id = t.doc_id)"
    ledgers = f"""WITH {gold}, {other}, oc AS (SELECT * FROM other WHERE doc_id IN (SELECT doc_id FROM other WHERE label = 'CITY')),
gc AS (SELECT * FROM gold WHERE doc_id IN (SELECT doc_id FROM gold WHERE label = 'CITY')),
gs AS (SELECT * FROM gold WHERE doc_id IN (SELECT doc_id FROM gold WHERE label = 'SURNAME')),
os AS (SELECT * FROM other WHERE doc_id IN (SELECT doc_id FROM gs)),
{diff('oc', 'gc', 'x')}, {diff('gs', 'os', 'y')},
od AS (SELECT DISTINCT doc_id FROM oc UNION SELECT DISTINCT doc_id FROM gc), nd AS (SELECT DISTINCT doc_id FROM gs),
led AS (
  SELECT nd.doc_id, coalesce(c.n, 0)::BIGINT AS n FROM nd LEFT JOIN ycnt c ON c.doc_id = nd.doc_id
  UNION ALL SELECT od.doc_id, coalesce(c.n, 0)::BIGINT FROM od LEFT JOIN xcnt c ON c.doc_id = od.doc_id WHERE od.doc_id NOT IN (SELECT doc_id FROM nd))"""
    decoded = f"""WITH {sql.rule_spans('spans', 'documents')} SELECT doc_id, original AS value, label, s AS start,
  round(exp(8.0) / (exp(8.0) + {len(TAGS) - 1}), 4)::DOUBLE AS confidence FROM spans"""
    em = "(SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)"
    return {
        "span_prf": f"{cmp_} {prf_cols}",
        "span_micro_macro": f"""{cmp_}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cf), m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM t)
SELECT round(2 * p * r / (p + r), 4) AS micro_f1, (SELECT round(avg(round(f, 4)), 4) FROM sc) AS macro_f1 FROM m""",
        "worst_labels": f"{cmp_} SELECT label, round(f, 4) AS f1 FROM sc ORDER BY round(f, 4), label LIMIT 5",
        "rule_prf": f"WITH {gold}, {sql.rule_spans('spans', 'gold_text', rules=detect.ALL_RULES)}, {confusion('spans')}, {prf()} {prf_cols}",
        "relaxed_prf": relaxed,
        "explain_sample": f"""{cmp_} SELECT c.doc_id, side, s AS start, label, marker, substr(t.text, s + 1, e - s) AS span_text FROM (
  SELECT doc_id, 'expected' AS side, s, e, label, CASE WHEN iq THEN 'TP' ELSE 'FN' END AS marker FROM cmp WHERE ig
  UNION ALL SELECT doc_id, 'predicted', s, e, label, CASE WHEN ig THEN 'TP' ELSE 'FP' END FROM cmp WHERE iq) c JOIN gold_text t ON t.doc_id = c.doc_id""",
        "latency_percentiles": f"SELECT event_type, round(avg(value), 2) AS mean, {quant} FROM events GROUP BY event_type",
        "latency_overall": f"SELECT round(avg(value), 2) AS mean, {quant} FROM events",
        "status_buckets": f"""WITH x AS (SELECT CASE event_type {codes} END AS c FROM events)
SELECT count_if(c BETWEEN 200 AND 299)::BIGINT AS s2xx, count_if(c BETWEEN 400 AND 499)::BIGINT AS s4xx, count_if(c BETWEEN 500 AND 599)::BIGINT AS s5xx,
  count_if(c < 200 OR c BETWEEN 300 AND 399 OR c > 599)::BIGINT AS other, count_if(c IS NULL)::BIGINT AS timeouts FROM x""",
        "roundtrip_rates": f"""WITH x AS (SELECT doc_id, {st} AS st, {leak} AS lk FROM documents)
SELECT count(*) AS total, round(count_if(st > 1) / count(*), 4) AS success_rate, round(count_if(lk = 0) / count(*), 4) AS leak_rate FROM x""",
        "tag_metrics": seq,
        "decoder_parity": f"""{cmp_}, k AS (SELECT doc_id, count_if(ig AND NOT iq)::BIGINT AS only_left, count_if(iq AND NOT ig)::BIGINT AS only_right FROM cmp GROUP BY doc_id)
SELECT doc_id, only_left + only_right = 0 AS equal, only_left, only_right FROM k""",
        "logit_diff": f"""SELECT vec_id, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same_argmax, round(list_max(d), 6) AS max_diff,
  round(list_sum(d) / len(d), 6) AS mean_diff, list_max(d) <= 0.1 AS close
FROM (SELECT *, list_transform(a, lambda x: x * 1.25) AS b, list_transform(a, lambda x: abs(x - x * 1.25)) AS d FROM {em})""",
        "topk_labels": f"""WITH x AS (SELECT vec_id, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS i, list_max(a) AS m FROM {em}),
p AS (SELECT vec_id, i, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rn FROM x)
SELECT vec_id, (rn - 1)::BIGINT AS pos, 'L' || i AS label, round(p, 6) AS probability FROM p WHERE rn <= 3""",
        "smoke_labels": f"""WITH {gold}, {other}, ex AS (SELECT DISTINCT doc_id, label FROM gold), ms AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS missing FROM ex
  WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.doc_id = ex.doc_id AND o.label = ex.label) GROUP BY doc_id)
SELECT t.doc_id, ms.missing IS NULL AS passed, coalesce(ms.missing, '') AS missing FROM gold_text t LEFT JOIN ms ON ms.doc_id = t.doc_id""",
        "decode_spans": decoded,
        "decode_argmax": decoded,
        "decode_bridged": decoded,
        "decode_trimmed": decoded,
        "detect_with_model": r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))::BIGINT AS n, true AS ok FROM documents""",
        "annotation_diff": f"{rev} SELECT file_name, issue_type, value, original_label, suggested_label, detail FROM det",
        "audit_counts": f"""{files} SELECT count(*) AS total, count_if(n = 0)::BIGINT AS clean, count_if(n > 0)::BIGINT AS dirty,
  round(100.0 * count_if(n = 0) / count(*), 1) AS clean_pct, round(100.0 * count_if(n > 0) / count(*), 1) AS dirty_pct FROM fl""",
        "issue_breakdown": f"""{rev}, lb AS (SELECT coalesce(original_label, suggested_label) AS name, count(*) AS n FROM iss GROUP BY 1 ORDER BY n DESC, name LIMIT 15)
SELECT 'issue_type' AS section, issue_type AS name, count(*) AS n FROM iss GROUP BY issue_type UNION ALL SELECT 'label', name, n FROM lb""",
        "noisiest_files": f"""{rev} SELECT file_name, count(*) AS issue_count, count_if(issue_type = 'WRONG_LABEL')::BIGINT AS wrong_label,
  count_if(issue_type = 'EXTRA')::BIGINT AS extra, count_if(issue_type = 'MISSING')::BIGINT AS missing FROM det GROUP BY file_name ORDER BY issue_count DESC, file_name LIMIT 20""",
        "example_issues": f"{rev} SELECT file_name, issue_type, pos FROM det JOIN cnt ON cnt.doc_id = det.doc_id ORDER BY cnt.n DESC, file_name, pos LIMIT 30",
        "corrected_samples": f"""{rev}, pl AS (SELECT o.doc_id, o.original, o.label, strpos(t.text, o.original) - 1 AS p0,
    row_number() OVER (PARTITION BY o.doc_id ORDER BY (o.c = 0.5), o.s) AS i
  FROM other o JOIN gold_text t ON t.doc_id = o.doc_id WHERE {std.replace('label', 'o.label')}),
en AS (SELECT doc_id, string_agg('ent-' || i || ':' || p0 || ':' || original || ':' || label, ';' ORDER BY i) AS entries FROM pl GROUP BY doc_id)
SELECT 'doc_' || cnt.doc_id || '.json' AS file_name, coalesce(entries, '') AS entries FROM cnt LEFT JOIN en ON en.doc_id = cnt.doc_id""",
        "ledger_merge": f"{ledgers} SELECT 'doc_' || doc_id || '.json' AS file_name, CASE WHEN n > 0 THEN 'DIRTY' ELSE 'CLEAN' END AS status, n AS issue_count FROM led",
        "ledger_rows": f"""{files}, sh AS (SELECT doc_id, string_agg(substr(detail, 1, 80), '; ' ORDER BY pos) AS t FROM det WHERE pos < 5 GROUP BY doc_id)
SELECT file_name, CASE WHEN n > 0 THEN 'DIRTY' ELSE 'CLEAN' END AS status, n AS issue_count, md5(coalesce(t, '')) AS issues_md5 FROM fl LEFT JOIN sh ON sh.doc_id = fl.doc_id""",
        "unreviewed": f"WITH {gold} SELECT 'doc_' || doc_id || '.json' AS file_name FROM gold_text WHERE doc_id NOT IN (SELECT doc_id FROM gold WHERE label = 'SURNAME')",
        "filter_by_ledger": f"{files} SELECT file_name, doc_id FROM fl WHERE n = 0",
    }
