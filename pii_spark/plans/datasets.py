"""Registered queries: annotated samples - normalising, profiling and training preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.dummies import hash_draw
from pii_spark.operators import batches, normalize, prepare, profiling, synth
from pii_spark.plans import oracle_parts as sql
from pii_spark.plans.corpora import (
    detected_documents, documents, file_name, privacy_mask, samples, second_annotation,
)


def _draw(tag: str, n: int):
    """A stable small number per document."""
    return hash_draw(F.concat_ws("|", F.lit(tag), F.col("doc_id").cast("string")), 0) % n


def _sql_draw(tag: str, n: int, key: str = "doc_id") -> str:
    return sql.draw(f"('{tag}|' || {key})", 0) + f" % {n}"


# -- samples and tasks -------------------------------------------------------------------------

def simplified(spark, sf):
    """Second annotations in the simplified shape; every first name starts a cluster."""
    s = second_annotation(samples(spark, sf))
    names = F.filter("entities", lambda e: e["label"] == "FIRSTNAME")
    clusters = F.transform(
        names,
        lambda e, i: F.struct(
            i.alias("cluster_id"), F.lit("person").alias("entity_type"), F.array(e["text"]).alias("mentions")
        ),
    )
    return privacy_mask(s.withColumn("coreferences", clusters))


def records(spark, sf):
    return normalize.normalize_simplified(simplified(spark, sf))


def _entries(entities):
    labels = F.transform(
        entities,
        lambda e, i: F.struct(
            F.concat(F.lit("ent-"), (i + 1).cast("string")).alias("id"), F.lit("entities").alias("from_name"),
            F.lit("text").alias("to_name"), F.lit("labels").alias("type"),
            F.struct(e["start"], e["end"], e["text"], F.array(e["label"]).alias("labels")).alias("value"),
            F.lit(None).cast("string").alias("from_id"), F.lit(None).cast("string").alias("to_id"),
            F.lit(None).cast("string").alias("direction"),
        ),
    ).cast(normalize.RESULTS)
    relation = F.array(F.struct(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("from_name"),
        F.lit(None).cast("string").alias("to_name"), F.lit("relation").alias("type"),
        F.lit(None).cast("struct<start:int,end:int,text:string,labels:array<string>>").alias("value"),
        F.lit("ent-2").alias("from_id"), F.lit("ent-1").alias("to_id"), F.lit("right").alias("direction"),
    )).cast(normalize.RESULTS)
    return F.when(F.size(entities) > 1, F.concat(labels, relation)).otherwise(labels)


def tasks(spark, sf):
    """Tasks with predictions (second annotation), annotations (gold), both or neither."""
    gold = samples(spark, sf)
    both = second_annotation(gold.withColumn("own", F.col("entities")))
    data = F.struct("text", "language", "country", file_name(F.col("doc_id")).alias("file_name"))
    predictions = F.array(F.struct(
        F.lit("m").alias("model_version"), F.lit(1.0).alias("score"), _entries(F.col("entities")).alias("result")
    )).cast(normalize.PREDICTIONS)
    annotations = F.array(F.struct(
        F.lit(1).cast("bigint").alias("id"), _entries(F.col("own")).alias("result")
    )).cast(normalize.ANNOTATIONS)
    return both.select(
        "doc_id", data.alias("data"),
        F.when(_draw("pred", 3) > 0, predictions).alias("predictions"),
        F.when(_draw("anno", 2) > 0, annotations).otherwise(F.array().cast(normalize.ANNOTATIONS)).alias("annotations"),
    )


def _joined(values, name):
    return F.array_join(values, ",").alias(name)


def _mask_line(mask):
    return F.array_join(
        F.transform(mask, lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["label"], e["value"])), ";"
    )


def _records_shown(r):
    return r.select(
        "doc_id", "language", "country", _joined("labels", "labels"), _joined("all_labels", "all_labels"),
        F.col("entity_count").cast("bigint").alias("entity_count"),
        F.size("entities").cast("bigint").alias("n_values"),
        F.col("coref_cluster_count").cast("bigint").alias("clusters"), "has_coreferences",
    )


def normalize_simplified(spark, sf):
    return _records_shown(records(spark, sf))


def normalize_tasks(spark, sf):
    return _records_shown(normalize.normalize_task(tasks(spark, sf)))


def audit_samples(spark, sf):
    s = normalize.task_to_sample(tasks(spark, sf))
    return s.select("doc_id", "language", _mask_line("privacy_mask").alias("mask"))


def training_samples(spark, sf):
    t = normalize.to_training_format(tasks(spark, sf))
    kept = normalize.drop_non_standard_samples(t.where(F.col("outcome") == "ok"))
    return kept.select("doc_id", _mask_line("privacy_mask").alias("mask"))


def load_report(spark, sf):
    t = normalize.to_training_format(tasks(spark, sf))
    return prepare.load_report(t.withColumn("non_standard", normalize.has_non_standard()))


_TO_FOREIGN = {ours: theirs for theirs, ours in reversed(list(fv.FOREIGN_LABELS.items()))}


def foreign_rows(spark, sf):
    """Samples with foreign labels; some offsets are missing and some are wrong."""
    names = F.create_map(*[F.lit(x) for pair in _TO_FOREIGN.items() for x in pair])
    quality = _draw("f", 3)
    mask = F.transform(
        "entities",
        lambda e: F.struct(
            e["text"].alias("value"), F.coalesce(F.try_element_at(names, e["label"]), F.lit("TITLE")).alias("label"),
            F.when(quality > 0, e["start"] + F.when(quality == 2, 1).otherwise(0)).alias("start"),
            F.when(quality > 0, e["end"]).alias("end"),
        ),
    )
    return samples(spark, sf).select("doc_id", F.col("text").alias("source_text"), mask.alias("privacy_mask"), "language")


def foreign_samples(spark, sf):
    s = normalize.import_foreign(foreign_rows(spark, sf))
    return s.select("doc_id", "language", _mask_line("privacy_mask").alias("mask"))


def occurrences(spark, sf):
    s = samples(spark, sf).select("doc_id", "text", F.explode("entities").alias("e"))
    s = s.select("doc_id", "text", F.col("e.start").cast("bigint").alias("start"), F.col("e.text").alias("value"),
                 F.substring("e.text", 1, 1).alias("lead"))
    plain = normalize.occurrences(s, "text", "lead")
    words = normalize.occurrences(plain.withColumnRenamed("positions", "p"), "text", "value", whole_words=True)
    return words.select(
        "doc_id", "start", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("lead_at"),
        F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("word_at"),
    )


def annotation_tasks(spark, sf):
    t = normalize.to_annotation_task(simplified(spark, sf))
    return (
        t.select("doc_id", F.explode(F.col("predictions")[0]["result"]).alias("r"))
        .select("doc_id", "r.id", F.col("r.value.start").cast("bigint").alias("start"),
                F.col("r.value.text").alias("value"), F.col("r.value.labels")[0].alias("label"))
    )


def _linked(spark, sf):
    """Clusters of full name, first name and two words of the text, over the samples that name a person."""
    s = samples(spark, sf)
    first = F.filter("entities", lambda e: e["label"] == "FIRSTNAME")
    last = F.filter("entities", lambda e: e["label"] == "SURNAME")
    mention = "struct<text:string,type:string,privacy_mask_labels:array<string>>"
    full = F.concat_ws(" ", F.get(first, F.lit(0))["text"], F.get(last, F.lit(0))["text"])
    mentions = F.transform(
        F.array(full, F.get(first, F.lit(0))["text"], F.lit("you"), F.lit("The")),
        lambda m: F.struct(
            m.alias("text"), normalize.infer_mention_type(m).alias("type"),
            F.lit(None).cast("array<string>").alias("privacy_mask_labels"),
        ).cast(mention),
    )
    clusters = F.when(
        F.size(first) > 0,
        F.array(F.struct(F.lit(1).alias("cluster_id"), F.lit("person").alias("entity_type"), mentions.alias("mentions"))),
    )
    linked = normalize.link_coreferences(privacy_mask(s.withColumn("coreferences", clusters.cast(normalize.CLUSTERS))))
    return linked.select("doc_id", F.col("predictions")[0]["result"].alias("result"))


def coreference_links(spark, sf):
    return _linked(spark, sf).select(
        "doc_id",
        F.size(F.filter("result", lambda r: r["type"] == "labels")).cast("bigint").alias("entries"),
        F.size(F.filter("result", lambda r: r["type"] == "relation")).cast("bigint").alias("relations"),
    )


def coreference_entries(spark, sf):
    rows = _linked(spark, sf).select("doc_id", F.explode("result").alias("r")).where("r.type = 'labels'")
    return rows.select(
        "doc_id", "r.id", F.col("r.value.start").cast("bigint").alias("start"), F.col("r.value.text").alias("value"),
        F.array_join("r.value.labels", ",").alias("label"),
    )


def coreference_relations(spark, sf):
    found = _linked(spark, sf).select("doc_id", F.filter("result", lambda r: r["type"] == "relation").alias("found"))
    return found.select("doc_id", F.posexplode("found").alias("i", "r")).select(
        "doc_id", F.col("i").cast("bigint").alias("i"), "r.from_id", "r.to_id", "r.direction"
    )


def mention_types(spark, sf):
    words = documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(prepare.WORD), F.lit(0))).alias("w"))
    return words.groupBy(normalize.infer_mention_type(F.col("w")).alias("type")).agg(F.count("*").alias("n"))


def mention_shapes(spark, sf):
    """Mentions as bare strings and as objects, both read from VARIANT."""
    bare = F.to_json(F.transform("entities", lambda e: e["text"]))
    objects = F.to_json(F.transform("entities", lambda e: F.struct(
        e["text"].alias("text"), F.lit("name").alias("type"), F.array(e["label"]).alias("privacy_mask_labels"))))
    shape = F.when(_draw("shape", 2) > 0, bare).otherwise(objects)
    m = samples(spark, sf).select("doc_id", normalize.normalize_mentions(F.parse_json(shape)).alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda x: F.concat_ws(
        ":", x["text"], x["type"], F.array_join(F.coalesce(x["privacy_mask_labels"], F.array().cast("array<string>")), "+"))), ";").alias("mentions"))


def task_metadata(spark, sf):
    s = privacy_mask(samples(spark, sf)).withColumn("file_name", file_name(F.col("doc_id")))
    t = normalize.attach_metadata(s, country=F.when(_draw("c", 2) > 0, F.lit("Elsewhere")))
    return t.select("doc_id", "data.language", "data.country", "data.file_name")


# -- batch requests and results ----------------------------------------------------------------

def batch_lines(spark, sf):
    """Result lines of several qualities, as text."""
    s = samples(spark, sf)
    sample = F.struct("text", F.when(_draw("lang", 2) > 0, F.col("language")).alias("language"))
    kind = _draw("kind", 6)
    content = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), F.to_json(F.array(sample, sample)), F.lit("\n```\nDone.")))
        .when(kind == 1, F.to_json(sample))
        .when(kind == 2, F.lit('"just a string"'))
        .otherwise(F.to_json(F.array(sample)))
    )
    meta = F.struct(F.col("language").alias("language"), F.col("doc_id").alias("sample_index"))
    code = F.when(kind == 3, 500).otherwise(200)
    choices = F.when(kind == 4, F.array().cast("array<struct<message:struct<content:string>>>")).otherwise(
        F.array(F.struct(F.struct(content.alias("content")).alias("message"))))
    line = F.struct(
        F.concat(F.lit("ner-request-"), F.col("doc_id").cast("string")).alias("custom_id"),
        F.struct(code.alias("status_code"), F.struct(choices.alias("choices"), meta.alias("metadata")).alias("body")).alias("response"),
    )
    return batches.parse_lines(s.select(F.to_json(line).alias("value")))


def batch_status(spark, sf):
    return batch_lines(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


def batch_samples(spark, sf):
    rows = batches.explode_samples(batch_lines(spark, sf), "file")
    return rows.select("custom_id", "file_name", F.md5(F.try_variant_get("sample", "$.text", "string")).alias("text_md5"))


def ner_results(spark, sf):
    rows = batches.parse_ner_results(batch_lines(spark, sf))
    return rows.select("custom_id", "language", "country", "sample_index",
                       F.md5(F.try_variant_get("ner_sample", "$.text", "string")).alias("text_md5"))


def review_samples(spark, sf):
    return batches.parse_for_review(batch_lines(spark, sf)).select("custom_id", "language", "country")


def unicode_escapes(spark, sf):
    broken = F.replace("text", F.lit("é"), F.lit("\\u0000e9"))
    return documents(spark, sf).select("doc_id", F.md5(batches.fix_unicode_escapes(broken)).alias("fixed_md5"))


def batch_requests(spark, sf):
    drawn = synth.sample_labels(samples(spark, sf), "doc_id", 4)
    s = samples(spark, sf).join(drawn, "doc_id").withColumn("sample_index", F.col("doc_id"))
    prompt = F.concat(F.lit("Write a text in "), F.col("language"), F.lit(" for "), F.col("country"), F.lit(" with "), F.array_join("labels", ", "))
    rows = batches.build_batch_requests(s, "ner", "doc_id", prompt, "model-a", F.lit(0.5), ["language", "country", "sample_index"])
    chained = batches.build_batch_requests(
        rows.withColumn("source_ner_id", F.col("custom_id")), "coref", "custom_id", F.lit("Link mentions."), "model-a", F.lit(0.2), ["source_ner_id"])

    def get(path):
        return F.get_json_object("value", path)

    first = rows.select("custom_id", get("$.body.messages[0].content").alias("content"), get("$.body.metadata.language").alias("meta"))
    return first.unionByName(chained.select("custom_id", get("$.body.messages[0].content").alias("content"), get("$.body.metadata.source_ner_id").alias("meta")))


# -- profiling -----------------------------------------------------------------------------------

def _bigints(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns])


def dataset_profile(spark, sf):
    p = profiling.dataset_profile(records(spark, sf))
    return _bigints(p, "total_samples", "unannotated", "entity_total", "entity_min", "entity_max", "text_len_min",
                    "text_len_max", "total_coref_clusters", "samples_with_coref")


def document_lengths(spark, sf):
    """The profile over the documents with their detected entities."""
    d = privacy_mask(detected_documents(spark, sf)).select(
        "doc_id", "text", "privacy_mask", F.lit(None).cast("array<int>").alias("coreferences"),
        F.col("lang").alias("language"), F.lit(None).cast("string").alias("country"))
    p = profiling.dataset_profile(normalize.normalize_simplified(d))
    return _bigints(p, "total_samples", "unannotated", "entity_total", "entity_min", "entity_max", "text_len_min",
                    "text_len_max", "total_coref_clusters", "samples_with_coref")


def language_distribution(spark, sf):
    return profiling.distribution(records(spark, sf), "language")


def country_distribution(spark, sf):
    return profiling.distribution(records(spark, sf), "country")


def label_distribution(spark, sf):
    return profiling.label_distribution(records(spark, sf))


def non_standard_labels(spark, sf):
    return profiling.non_standard_labels(records(spark, sf), profiling.labels_dimension(spark))


def label_pairs(spark, sf):
    return profiling.label_pairs(records(spark, sf))


def all_label_pairs(spark, sf):
    return profiling.label_pairs(records(spark, sf), None)


def value_diversity(spark, sf):
    return profiling.value_diversity(records(spark, sf))


def top_values(spark, sf):
    return _bigints(profiling.top_values(records(spark, sf)), "rank")


def card_countries(spark, sf):
    return profiling.card_countries(records(spark, sf), 12)


# -- training preparation --------------------------------------------------------------------------

def tagged_samples(spark, sf):
    return prepare.align_bio(privacy_mask(samples(spark, sf)))


def token_bio(spark, sf):
    t = tagged_samples(spark, sf)
    pairs = F.zip_with("tokens", "tags", lambda x, y: F.concat_ws("/", x["text"], y))
    return t.select("doc_id", F.array_join(pairs, " ").alias("tagged"))


def overlap_bio(spark, sf):
    """Tags of gold and second entities together, so that many spans overlap."""
    gold = samples(spark, sf)
    other = second_annotation(gold).select("doc_id", F.col("entities").alias("more"))
    both = gold.join(other, "doc_id").withColumn("entities", F.array_distinct(F.concat("entities", "more")))
    t = prepare.align_bio(privacy_mask(both))
    return t.select("doc_id", F.array_join("tags", " ").alias("tags"))


def document_bio(spark, sf):
    t = prepare.align_bio(privacy_mask(detected_documents(spark, sf)))
    return prepare.tag_counts(t)


def drop_overlaps(spark, sf):
    gold = samples(spark, sf)
    other = second_annotation(gold).select("doc_id", F.col("entities").alias("more"))
    both = privacy_mask(gold.join(other, "doc_id").withColumn("entities", F.concat("entities", "more")))
    return both.select("doc_id", _mask_line(prepare.drop_overlaps(F.col("privacy_mask"))).alias("kept"))


def class_weights(spark, sf):
    return prepare.class_weights(tagged_samples(spark, sf))


def label_vocabulary(spark, sf):
    counts = prepare.tag_counts(tagged_samples(spark, sf))
    v = prepare.label_vocabulary(spark).join(counts, "tag", "left")
    return v.select(F.col("id").cast("bigint").alias("id"), "tag", F.coalesce("n", F.lit(0)).alias("n"))


def typed_samples(spark, sf):
    t = tagged_samples(spark, sf)
    return t.select("doc_id", prepare.entity_types(F.col("tags")).alias("types"))


def sample_entity_types(spark, sf):
    return typed_samples(spark, sf).select("doc_id", F.array_join("types", ",").alias("types"))


def split_hash(spark, sf):
    return prepare.split_random(documents(spark, sf).select("doc_id"), "doc_id", 0.1, 42)


def split_balanced(spark, sf):
    s = prepare.split_balanced(typed_samples(spark, sf), "doc_id", "types", 0.1, 42)
    return s.select("doc_id", "split")


def cap_samples(spark, sf):
    return prepare.cap_samples(documents(spark, sf).select("doc_id", "lang"), "doc_id", 300, 7)


def combined_sets(spark, sf):
    local = samples(spark, sf).select(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("sid"), "text", "country")
    foreign = normalize.import_foreign(foreign_rows(spark, sf)).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("sid"), "text")
    both = prepare.combine_sets(local, foreign, "sid")
    return both.select("sid", "country", "shuffle_key", F.md5("text").alias("text_md5"))


def sample_labels(spark, sf):
    s = synth.sample_labels(documents(spark, sf).select("doc_id"), "doc_id", 10)
    return s.select("doc_id", F.array_join("labels", ",").alias("labels"))


def sample_language_country(spark, sf):
    return synth.sample_language_country(documents(spark, sf).select("doc_id"), "doc_id")


def synth_samples(spark, sf):
    s = samples(spark, sf)
    spans = F.transform("entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["label"]))
    return s.select(synth.sample_id(F.col("doc_id")).alias("sid"), "text", F.array_join(spans, ",").alias("spans"))


def label_coverage(spark, sf):
    return synth.label_coverage(samples(spark, sf), profiling.labels_dimension(spark), 60)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_simplified, normalize_tasks, audit_samples, training_samples, load_report, foreign_samples,
        occurrences, annotation_tasks, coreference_links, coreference_entries, coreference_relations, mention_types, mention_shapes, task_metadata,
        batch_status, batch_samples, ner_results, review_samples, unicode_escapes, batch_requests,
        dataset_profile, document_lengths, language_distribution, country_distribution, label_distribution,
        non_standard_labels, label_pairs, all_label_pairs, value_diversity, top_values, card_countries,
        token_bio, overlap_bio, document_bio, drop_overlaps, class_weights, label_vocabulary,
        sample_entity_types, split_hash, split_balanced, cap_samples, combined_sets, sample_labels,
        sample_language_country, synth_samples, label_coverage,
    )
}


def oracles() -> dict[str, str]:
    gold, other, lc = sql.synthetic(), sql.second(), sql.language_country()
    std = f"list_contains({sql.STANDARD}, label)"
    order = "(c = 0.5), s"
    recs = f"""WITH {gold}, {other}, {lc}, o AS (SELECT *, {std} AS std FROM other), a AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY {order}) FILTER (std) AS labels, string_agg(label, ',' ORDER BY {order}) AS all_labels,
    count_if(std)::BIGINT AS n, count_if(label = 'FIRSTNAME')::BIGINT AS cl FROM o GROUP BY doc_id
), rec AS (
  SELECT lc.doc_id, lc.language, lc.country, t.text, coalesce(a.labels, '') AS labels, coalesce(a.all_labels, '') AS all_labels,
    coalesce(a.n, 0)::BIGINT AS n, coalesce(a.cl, 0)::BIGINT AS cl
  FROM lc JOIN gold_text t ON t.doc_id = lc.doc_id LEFT JOIN a ON a.doc_id = lc.doc_id
)"""
    # Claims of the mask, then four mentions one after the other: entries so far, and what a mention found.
    links = f"""WITH RECURSIVE {gold}, mk AS (
  SELECT g.doc_id, g.original, g.label, t.text, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.s) AS i
  FROM gold g JOIN gold_text t ON t.doc_id = g.doc_id
), st AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used, []::STRUCT(s BIGINT, v VARCHAR, l VARCHAR)[] AS out FROM gold_text
  UNION ALL
  SELECT doc_id, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END,
    CASE WHEN p IS NULL THEN out ELSE list_append(out, {{'s': p, 'v': original, 'l': label}}) END
  FROM (SELECT st.doc_id, mk.i, st.used, st.out, mk.original, mk.label,
      list_min(list_filter(range(0, length(mk.text)::BIGINT), lambda p: substr(mk.text, p + 1, length(mk.original)) = mk.original
        AND NOT list_contains(st.used, p))) AS p
    FROM st JOIN mk ON mk.doc_id = st.doc_id AND mk.i = st.i + 1)
), fin AS (SELECT doc_id, arg_max(out, i) AS out FROM st GROUP BY doc_id),
e0 AS (SELECT doc_id, generate_subscripts(out, 1) AS n, unnest(out).s AS ps, unnest(out).v AS value, unnest(out).l AS label, true AS used FROM fin),
who AS (
  SELECT doc_id, first(original ORDER BY s) FILTER (label = 'FIRSTNAME') AS f, first(original ORDER BY s) FILTER (label = 'SURNAME') AS l
  FROM gold GROUP BY doc_id HAVING count(*) FILTER (label = 'FIRSTNAME') > 0
), men AS (
  SELECT doc_id, unnest([1, 2, 3, 4]) AS j, unnest([concat_ws(' ', f, l), f, 'you', 'The']) AS value, f AS head, l IS NOT NULL AS several FROM who
), hit AS (
  SELECT m.*, t.text, CASE WHEN regexp_matches(t.text, '\\b' || value || '\\b') THEN '' ELSE '(?i)' END || '\\b' || value || '\\b' AS rx
  FROM men m JOIN gold_text t ON t.doc_id = m.doc_id
), cut AS (
  SELECT doc_id, j, value, head, several AND j = 1 AS several, unnest(regexp_extract_all(text, rx)) AS v, unnest(string_split_regex(text, rx)) AS g,
    generate_subscripts(string_split_regex(text, rx), 1) AS i FROM hit
), spot AS (
  SELECT doc_id, j, value, head, several, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id, j ORDER BY i))::BIGINT - length(v) AS ps
  FROM cut WHERE v IS NOT NULL
)"""
    for j in range(1, 5):
        links += f""", a{j} AS (
  SELECT s.doc_id, s.value, s.ps, k.n AS known, CASE WHEN k.n IS NOT NULL THEN 'known' WHEN s.several AND h.n IS NOT NULL THEN 'bare'
    WHEN u.doc_id IS NULL THEN 'label' END AS act
  FROM spot s LEFT JOIN e{j - 1} k ON k.doc_id = s.doc_id AND k.value = s.value AND k.ps = s.ps
  LEFT JOIN e{j - 1} h ON h.doc_id = s.doc_id AND h.value = s.head AND h.ps = s.ps
  LEFT JOIN (SELECT DISTINCT doc_id, ps FROM e{j - 1} WHERE used) u ON u.doc_id = s.doc_id AND u.ps = s.ps
  WHERE s.j = {j}
), b{j} AS (
  SELECT a.doc_id, a.value, a.ps, act, coalesce(c.n, 0) + row_number() OVER (PARTITION BY a.doc_id ORDER BY a.ps) AS n
  FROM a{j} a LEFT JOIN (SELECT doc_id, count(*) AS n FROM e{j - 1} GROUP BY doc_id) c ON c.doc_id = a.doc_id WHERE act IN ('bare', 'label')
), e{j} AS (
  SELECT * FROM e{j - 1} UNION ALL SELECT doc_id, n, ps, value, CASE WHEN act = 'label' THEN 'PRONOUN' END, act = 'label' FROM b{j}
), f{j} AS (
  SELECT doc_id, value, ps, known AS n, {j} AS j FROM a{j} WHERE act = 'known' UNION ALL SELECT doc_id, value, ps, n, {j} FROM b{j}
)"""
    links += """, f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4),
chain AS (
  SELECT m.doc_id, f.n AS other, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.j, f.j, f.ps) AS i
  FROM men m JOIN f ON f.doc_id = m.doc_id AND f.value = m.value
), rel AS (
  SELECT c.doc_id, c.i - 2 AS i, c.other, h.other AS head FROM chain c JOIN chain h ON h.doc_id = c.doc_id AND h.i = 1 WHERE c.i > 1
)"""
    profile = """SELECT count(*) AS total_samples, count_if(n = 0)::BIGINT AS unannotated, sum(n)::BIGINT AS entity_total, round(avg(n), 4) AS entity_avg,
  min(n) AS entity_min, max(n) AS entity_max, min(length(text))::BIGINT AS text_len_min, max(length(text))::BIGINT AS text_len_max,
  round(avg(length(text)), 4) AS text_len_avg, median(length(text))::DOUBLE AS text_len_median, sum(cl)::BIGINT AS total_coref_clusters,
  count_if(cl > 0)::BIGINT AS samples_with_coref, round(100.0 * count_if(cl > 0) / count(*), 4) AS coref_pct FROM rec"""

    # Annotation tasks: which source counts, and its entities.
    pred, anno = _sql_draw("pred", 3), _sql_draw("anno", 2)
    has = f"""has AS (SELECT doc_id, ({pred}) > 0 AS p, ({anno}) > 0 AS a FROM documents)"""
    base = f"WITH {gold}, {other}, {lc}, {has}"

    def task_rows(first: str) -> str:
        use_pred = "h.p" if first == "predictions" else "(h.p AND NOT h.a)"
        use_gold = "(h.a AND NOT h.p)" if first == "predictions" else "h.a"
        return f"""src AS (
  SELECT o.doc_id, o.original, o.label, o.s, o.e, o.c FROM other o JOIN has h ON h.doc_id = o.doc_id WHERE {use_pred}
  UNION ALL SELECT g.doc_id, g.original, g.label, g.s, g.e, g.c FROM gold g JOIN has h ON h.doc_id = g.doc_id WHERE {use_gold}
)"""

    line = f"string_agg(s || ':' || e || ':' || label || ':' || original, ';' ORDER BY {order})"
    foreign = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TO_FOREIGN.items())
    back = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.FOREIGN_LABELS.items())
    fq = _sql_draw("f", 3, "g.doc_id")
    imported = f"""fr AS (
  SELECT g.doc_id, g.original, CASE label {foreign} ELSE 'TITLE' END AS fl, t.text, g.s AS ord,
    CASE WHEN {fq} > 0 THEN g.s + CASE WHEN {fq} = 2 THEN 1 ELSE 0 END END AS s, CASE WHEN {fq} > 0 THEN g.e END AS e
  FROM gold g JOIN gold_text t ON t.doc_id = g.doc_id
), im AS (
  SELECT doc_id, original, CASE fl {back} END AS label, text, ord,
    CASE WHEN s IS NOT NULL THEN s ELSE strpos(text, original) - 1 END AS s,
    CASE WHEN s IS NOT NULL THEN e ELSE strpos(text, original) - 1 + length(original) END AS e
  FROM fr WHERE CASE fl {back} END IS NOT NULL AND (s IS NULL OR substr(text, s + 1, e - s) = original)
)"""

    kind = _sql_draw("kind", 6)
    lang = _sql_draw("lang", 2)
    lines = f"""WITH {gold}, {lc}, bl AS (
  SELECT lc.doc_id, lc.language, lc.country, t.text, {kind.replace('doc_id', 'lc.doc_id')} AS kind, {lang.replace('doc_id', 'lc.doc_id')} AS lg
  FROM lc JOIN gold_text t ON t.doc_id = lc.doc_id
), ok AS (SELECT *, 'ner-request-' || doc_id AS custom_id, CASE kind WHEN 0 THEN 2 ELSE 1 END AS n FROM bl WHERE kind IN (0, 1, 5)),
ex AS (SELECT *, unnest(range(n)) AS ix FROM ok)"""

    def bio(mask: str) -> str:
        """CTEs ending in tg(doc_id, i, v, tag) for spans ``mask``(doc_id, label, s, e)."""
        return f"""tk AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {sql.TOKEN})) AS v, unnest(string_split_regex(text, {sql.TOKEN})) AS g,
    generate_subscripts(string_split_regex(text, {sql.TOKEN}), 1) AS i FROM btext
), pos AS (
  SELECT doc_id, v, i, (sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(v) AS ts FROM tk WHERE v IS NOT NULL
), cand AS (
  SELECT p.doc_id, p.i, m.s, m.e, m.label, row_number() OVER (PARTITION BY p.doc_id, p.i
    ORDER BY least(p.ts + length(p.v), m.e) - greatest(p.ts, m.s) DESC, m.s, m.e, m.label) AS rn
  FROM pos p JOIN {mask} m ON m.doc_id = p.doc_id AND p.ts < m.e AND m.s < p.ts + length(p.v)
), best AS (
  SELECT p.doc_id, p.i, p.v, c.s, c.e, c.label FROM pos p LEFT JOIN cand c ON c.doc_id = p.doc_id AND c.i = p.i AND c.rn = 1
), tg AS (
  SELECT doc_id, i, v, CASE WHEN label IS NULL THEN 'O'
    WHEN lag(s) OVER w = s AND lag(e) OVER w = e AND lag(label) OVER w = label THEN 'I-' || label ELSE 'B-' || label END AS tag
  FROM best WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""

    gbio = f"WITH {gold}, btext AS (SELECT * FROM gold_text), {bio('gold')}"
    sp = "STRUCT(s BIGINT, e BIGINT, label VARCHAR, v VARCHAR)"
    greedy = f"""kept AS (
  SELECT doc_id, list_reduce(list({{'k': [{{'s': s, 'e': e, 'label': label, 'v': original}}::{sp}]}} ORDER BY e - s DESC, s, label),
    lambda a, b: CASE WHEN len(list_filter(a.k, lambda y: b.k[1].s < y.e AND y.s < b.k[1].e)) > 0 THEN a ELSE {{'k': list_concat(a.k, b.k)}} END) AS r
  FROM allspans GROUP BY doc_id
), kspans AS (SELECT doc_id, x.s AS s, x.e AS e, x.label AS label, x.v AS original FROM (SELECT doc_id, unnest(r.k) AS x FROM kept))"""
    types = f"""ty AS (SELECT DISTINCT doc_id, label FROM gold)"""
    vocab = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS id, '{t}' AS tag"
        for i, t in [*enumerate(["O"] + [f"{p}-{x}" for x in fv.STANDARD_LABELS for p in "BI"]), (fv.IGNORE_ID, "IGNORE")]
    )

    def order_md5(seed: int, key: str = "doc_id") -> str:
        return f"md5('{seed}|' || {key})"

    weight = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.LABEL_CHANCE.items())
    labels = " UNION ALL ".join(f"SELECT '{x}' AS label" for x in fv.STANDARD_LABELS)
    address = sql.word_list(fv.ADDRESS_LABELS)
    keyed = sql.draw("('42|' || doc_id || '|' || label)", 0)
    drawn = f"""lk AS (
  SELECT doc_id, label, -ln(({keyed} + 1) / 4294967297.0) / (CASE label {weight} ELSE {fv.DEFAULT_CHANCE} END) AS k FROM documents, ({labels})
), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, label) AS rn FROM lk)"""

    def drawn_labels(n: int) -> str:
        return f"""{drawn}, pk AS (SELECT doc_id, list(label) AS ls FROM rk WHERE rn <= {n} GROUP BY doc_id),
cl AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN list_has_any(ls, {address}) THEN list_concat(ls, {address}) ELSE ls END)) AS ls FROM pk)"""

    lead = "substr(g.original, 1, 1)"
    word = r"('\b\Q' || g.original || '\E\b')"
    shape = _sql_draw("shape", 2)
    return {
        "normalize_simplified": f"{recs} SELECT doc_id, language, country, labels, all_labels, n AS entity_count, n AS n_values, cl AS clusters, cl > 0 AS has_coreferences FROM rec",
        "normalize_tasks": f"""{base}, {task_rows('predictions')}, o AS (SELECT *, {std} AS std FROM src), a AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY {order}) FILTER (std) AS labels, string_agg(label, ',' ORDER BY {order}) AS all_labels,
    count_if(std)::BIGINT AS n, count(*) AS m FROM o GROUP BY doc_id
) SELECT lc.doc_id, language, country, coalesce(labels, '') AS labels, coalesce(all_labels, '') AS all_labels, coalesce(n, 0)::BIGINT AS entity_count,
  coalesce(n, 0)::BIGINT AS n_values, CASE WHEN m > 1 THEN 1 ELSE 0 END::BIGINT AS clusters, coalesce(m > 1, false) AS has_coreferences
FROM lc LEFT JOIN a ON a.doc_id = lc.doc_id""",
        "audit_samples": f"""{base}, {task_rows('annotations')}, a AS (SELECT doc_id, {line} AS mask FROM src GROUP BY doc_id)
SELECT lc.doc_id, language, coalesce(mask, '') AS mask FROM lc LEFT JOIN a ON a.doc_id = lc.doc_id""",
        "training_samples": f"""{base}, {task_rows('annotations')}, a AS (SELECT doc_id, {line} AS mask, bool_and({std}) AS ok FROM src GROUP BY doc_id)
SELECT doc_id, mask FROM a WHERE ok""",
        "load_report": f"""{base}, {task_rows('annotations')}, a AS (SELECT doc_id, bool_and({std}) AS ok FROM src GROUP BY doc_id)
SELECT count(*) AS available, count_if(ok)::BIGINT AS processed, count_if(NOT ok)::BIGINT AS non_standard, count_if(ok IS NULL)::BIGINT AS conversion_errors
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
        "foreign_samples": f"""WITH {gold}, {lc}, {imported}
SELECT im.doc_id, any_value(language) AS language, string_agg(s || ':' || e || ':' || label || ':' || original, ';' ORDER BY ord) AS mask
FROM im JOIN lc ON lc.doc_id = im.doc_id GROUP BY im.doc_id""",
        "occurrences": f"""WITH {gold}, tx AS (
  SELECT g.doc_id, g.s AS start, t.text, {lead} AS lead, regexp_extract_all(t.text, {word}) AS hits, string_split_regex(t.text, {word}) AS gaps
  FROM gold g JOIN gold_text t ON t.doc_id = g.doc_id
), a AS (SELECT doc_id, start, text, lead, unnest(range(0, length(text)::BIGINT)) AS p FROM tx),
la AS (SELECT doc_id, start, string_agg(p::VARCHAR, ',' ORDER BY p) AS lead_at FROM a WHERE substr(text, p + 1, 1) = lead GROUP BY doc_id, start),
b AS (SELECT doc_id, start, unnest(hits) AS v, unnest(gaps) AS g, generate_subscripts(gaps, 1) AS i FROM tx),
bb AS (SELECT doc_id, start, v, i, sum(length(g) + length(v)) OVER (PARTITION BY doc_id, start ORDER BY i) - length(v) AS p FROM b WHERE v IS NOT NULL),
wa AS (SELECT doc_id, start, string_agg(p::BIGINT::VARCHAR, ',' ORDER BY i) AS word_at FROM bb GROUP BY doc_id, start)
SELECT la.doc_id, la.start, lead_at, coalesce(word_at, '') AS word_at FROM la LEFT JOIN wa ON wa.doc_id = la.doc_id AND wa.start = la.start""",
        "coreference_links": f"""{links}, e AS (SELECT doc_id, count(*) AS n FROM e4 GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM rel GROUP BY doc_id)
SELECT t.doc_id, coalesce(e.n, 0) AS entries, coalesce(r.n, 0) AS relations
FROM gold_text t LEFT JOIN e ON e.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id""",
        "coreference_entries": f"""{links} SELECT doc_id, 'ent-' || n AS id, ps AS start, value, coalesce(label, '') AS label FROM e4""",
        "coreference_relations": f"""{links} SELECT doc_id, i, 'ent-' || other AS from_id, 'ent-' || head AS to_id, 'right' AS direction FROM rel""",
        "annotation_tasks": f"""WITH RECURSIVE {gold}, {other}, mk AS (
  SELECT o.doc_id, o.original, o.label, t.text, row_number() OVER (PARTITION BY o.doc_id ORDER BY {order}) AS i
  FROM other o JOIN gold_text t ON t.doc_id = o.doc_id
), st AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used, []::STRUCT(s BIGINT, v VARCHAR, l VARCHAR)[] AS out FROM gold_text
  UNION ALL
  SELECT doc_id, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END,
    CASE WHEN p IS NULL THEN out ELSE list_append(out, {{'s': p, 'v': original, 'l': label}}) END
  FROM (SELECT st.doc_id, mk.i, st.used, st.out, mk.original, mk.label,
      list_filter(range(0, length(mk.text)::BIGINT), lambda x: substr(mk.text, x + 1, length(mk.original)) = mk.original AND NOT list_contains(st.used, x))[1] AS p
    FROM st JOIN mk ON mk.doc_id = st.doc_id AND mk.i = st.i + 1)
), fin AS (SELECT doc_id, arg_max(out, i) AS out FROM st GROUP BY doc_id),
fl AS (SELECT doc_id, unnest(out) AS x, generate_subscripts(out, 1) AS n FROM fin)
SELECT doc_id, 'ent-' || n AS id, x.s AS start, x.v AS value, x.l AS label FROM fl""",
        "mention_types": f"""SELECT CASE WHEN list_contains({sql.word_list(fv.PRONOUNS)}, lower(w)) THEN 'pronoun' ELSE 'reference' END AS type, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, {sql.WORD})) AS w FROM documents) GROUP BY 1""",
        "mention_shapes": f"""WITH {gold}, m AS (SELECT *, {shape} AS sh FROM gold)
SELECT doc_id, string_agg(original || ':' || CASE WHEN sh > 0 THEN CASE WHEN list_contains({sql.word_list(fv.PRONOUNS)}, lower(original)) THEN 'pronoun' ELSE 'reference' END || ':'
  ELSE 'name:' || label END, ';' ORDER BY s) AS mentions FROM m GROUP BY doc_id""",
        "task_metadata": f"WITH {lc} SELECT doc_id, language, CASE WHEN ({_sql_draw('c', 2)}) > 0 THEN 'Elsewhere' ELSE country END AS country, 'doc_' || doc_id || '.json' AS file_name FROM lc",
        "batch_status": f"""{lines} SELECT CASE kind WHEN 2 THEN 'bad_content' WHEN 3 THEN 'bad_status' WHEN 4 THEN 'no_choices' ELSE 'ok' END AS status, count(*) AS n FROM bl GROUP BY 1""",
        "batch_samples": f"{lines} SELECT custom_id, 'file-' || custom_id || CASE WHEN n > 1 THEN '_' || ix ELSE '' END || '.json' AS file_name, md5(text) AS text_md5 FROM ex",
        "ner_results": f"{lines} SELECT custom_id, language, 'United States' AS country, doc_id AS sample_index, md5(text) AS text_md5 FROM ok",
        "review_samples": f"{lines} SELECT custom_id, CASE WHEN lg > 0 THEN language ELSE 'English' END AS language, 'United States' AS country FROM ex",
        "unicode_escapes": r"SELECT doc_id, md5(replace(text, 'é', '\u00e9')) AS fixed_md5 FROM documents",
        "batch_requests": f"""WITH {lc}, {drawn_labels(4)}
SELECT 'ner-request-' || lc.doc_id AS custom_id, 'Write a text in ' || language || ' for ' || country || ' with ' || array_to_string(ls, ', ') AS content, language AS meta
FROM lc JOIN cl ON cl.doc_id = lc.doc_id
UNION ALL SELECT 'coref-ner-request-' || doc_id, 'Link mentions.', 'ner-request-' || doc_id FROM lc""",
        "dataset_profile": f"{recs} {profile}",
        "document_lengths": f"""WITH {sql.rule_spans('spans', 'documents')}, k AS (SELECT doc_id, count(*) AS n FROM spans WHERE {std} GROUP BY doc_id),
rec AS (SELECT d.text, coalesce(k.n, 0)::BIGINT AS n, 0 AS cl FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id) {profile}""",
        "language_distribution": f"{recs} SELECT language, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM rec), 4) AS pct FROM rec GROUP BY language",
        "country_distribution": f"{recs} SELECT country, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM rec), 4) AS pct FROM rec GROUP BY country",
        "label_distribution": f"{recs} SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT sum(n) FROM rec), 4) AS pct FROM o WHERE std GROUP BY label",
        "non_standard_labels": f"{recs} SELECT label, count(*) AS n FROM o WHERE NOT std GROUP BY label",
        "label_pairs": f"""{recs}, u AS (SELECT DISTINCT doc_id, label FROM o WHERE std)
SELECT x.label AS label_a, y.label AS label_b, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.label < y.label GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""",
        "all_label_pairs": f"""{recs}, u AS (SELECT DISTINCT doc_id, label FROM o WHERE std)
SELECT x.label AS label_a, y.label AS label_b, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.label < y.label GROUP BY 1, 2""",
        "value_diversity": f"{recs} SELECT label, count(DISTINCT original) AS distinct_values, count(*)::BIGINT AS n FROM o WHERE std GROUP BY label",
        "top_values": f"""{recs}, q AS (SELECT label, original AS value, count(*) AS n FROM o WHERE std GROUP BY 1, 2)
SELECT label, value, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, value)::BIGINT AS rank FROM q QUALIFY rank <= 5""",
        "card_countries": f"""{recs}, q AS (SELECT country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country) AS r FROM rec GROUP BY country),
z AS (SELECT country, n FROM q WHERE r <= 12 UNION ALL SELECT '(' || count(*) || ' more)', sum(n)::BIGINT FROM q WHERE r > 12 HAVING count(*) > 0)
SELECT country, n, round(100.0 * n / (SELECT count(*) FROM rec), 4) AS pct FROM z""",
        "token_bio": f"{gbio} SELECT doc_id, string_agg(v || '/' || tag, ' ' ORDER BY i) AS tagged FROM tg GROUP BY doc_id",
        "overlap_bio": f"""WITH {gold}, {other}, allspans AS (
  SELECT DISTINCT doc_id, original, label, s, e FROM (SELECT * FROM gold UNION ALL SELECT * FROM other)
), {greedy}, btext AS (SELECT * FROM gold_text), {bio('kspans')} SELECT doc_id, string_agg(tag, ' ' ORDER BY i) AS tags FROM tg GROUP BY doc_id""",
        "document_bio": f"WITH {sql.rule_spans('spans', 'documents')}, btext AS (SELECT doc_id, text FROM documents), {bio('spans')} SELECT tag, count(*) AS n FROM tg GROUP BY tag",
        "drop_overlaps": f"""WITH {gold}, {other}, allspans AS (SELECT * FROM gold UNION ALL SELECT * FROM other), {greedy}
SELECT doc_id, string_agg(s || ':' || e || ':' || label || ':' || original, ';' ORDER BY s DESC) AS kept FROM kspans GROUP BY doc_id""",
        "class_weights": f"""{gbio}, n AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag),
w AS (SELECT tag, n, CASE WHEN tag <> 'O' THEN sqrt((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)) END AS w FROM n)
SELECT tag, n, round(CASE WHEN tag = 'O' THEN 1.0 ELSE w / (SELECT avg(w) FROM w) END, 6)::DOUBLE AS weight FROM w""",
        "label_vocabulary": f"{gbio}, n AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag), vb AS ({vocab}) SELECT id, vb.tag, coalesce(n.n, 0)::BIGINT AS n FROM vb LEFT JOIN n ON n.tag = vb.tag",
        "sample_entity_types": f"WITH {gold}, {types} SELECT doc_id, string_agg(label, ',' ORDER BY label) AS types FROM ty GROUP BY doc_id",
        "split_hash": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {order_md5(42)}, doc_id) <=
  least(greatest(floor((SELECT count(*) FROM documents) * 0.1), 1), (SELECT count(*) FROM documents) - 1) THEN 'validation' ELSE 'train' END AS split FROM documents""",
        "split_balanced": f"""WITH {gold}, {types}, f AS (SELECT label, count(*) AS f FROM ty GROUP BY label),
sc AS (SELECT ty.doc_id, ty.label, f.f FROM ty JOIN f ON f.label = ty.label),
ra AS (SELECT doc_id, sum(round(1e9 / f)::BIGINT)::BIGINT AS rarity FROM sc GROUP BY doc_id),
rk AS (SELECT sc.doc_id, row_number() OVER (PARTITION BY label ORDER BY rarity DESC, {order_md5(42, 'sc.doc_id')}, sc.doc_id) AS rn, greatest(1, round(f * 0.1)) AS want
  FROM sc JOIN ra ON ra.doc_id = sc.doc_id),
nm AS (SELECT doc_id, bool_or(rn <= want) AS nominated FROM rk GROUP BY doc_id),
fi AS (SELECT t.doc_id, row_number() OVER (ORDER BY CASE WHEN coalesce(nominated, false) THEN -rarity ELSE 1 END, {order_md5(42, 't.doc_id')}, t.doc_id) AS rn
  FROM gold_text t LEFT JOIN nm ON nm.doc_id = t.doc_id LEFT JOIN ra ON ra.doc_id = t.doc_id)
SELECT doc_id, CASE WHEN rn <= greatest(floor((SELECT count(*) FROM fi) * 0.1), 1) THEN 'validation' ELSE 'train' END AS split FROM fi""",
        "cap_samples": f"SELECT doc_id, lang FROM documents ORDER BY {order_md5(7)}, doc_id LIMIT 300",
        "combined_sets": f"""WITH {gold}, {lc}, {imported}, b AS (
  SELECT 'l' || t.doc_id AS sid, country, text FROM gold_text t JOIN lc ON lc.doc_id = t.doc_id
  UNION ALL SELECT DISTINCT 'f' || doc_id, NULL, text FROM im)
SELECT sid, country, {order_md5(42, 'sid')} AS shuffle_key, md5(text) AS text_md5 FROM b""",
        "sample_labels": f"WITH {drawn_labels(10)} SELECT doc_id, array_to_string(ls, ',') AS labels FROM cl",
        "sample_language_country": f"WITH {lc} SELECT doc_id, language, country FROM lc",
        "synth_samples": f"""WITH {gold}, a AS (SELECT doc_id, string_agg(s || ':' || e || ':' || label, ',' ORDER BY s) AS spans FROM gold GROUP BY doc_id)
SELECT 's' || CASE WHEN length(t.doc_id::VARCHAR) < 4 THEN lpad(t.doc_id::VARCHAR, 4, '0') ELSE t.doc_id::VARCHAR END AS sid, text, spans
FROM gold_text t JOIN a ON a.doc_id = t.doc_id""",
        "label_coverage": f"""WITH {gold}, n AS (SELECT label, count(*) AS n FROM gold GROUP BY label), l AS ({labels})
SELECT l.label, coalesce(n.n, 0)::BIGINT AS n, coalesce(n.n, 0) < 60 AS under_represented FROM l LEFT JOIN n ON n.label = l.label""",
    }
