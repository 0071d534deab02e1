"""Annotated samples of several shapes brought into one, and back into annotation tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import (
    bind,
    compute_once,
    empty,
    find_value,
    find_word,
    groups_sql,
    let_sql,
    spots_sql,
)

MASK = "array<struct<value:string,label:string,start:int,end:int>>"
MENTION = "struct<text:string,type:string,privacy_mask_labels:array<string>>"
CLUSTERS = f"array<struct<cluster_id:int,entity_type:string,mentions:array<{MENTION}>>>"
RESULT = (
    "struct<id:string,from_name:string,to_name:string,type:string,"
    "value:struct<start:int,end:int,text:string,labels:array<string>>,"
    "from_id:string,to_id:string,direction:string>"
)
RESULTS = f"array<{RESULT}>"
DATA = "struct<text:string,language:string,country:string,file_name:string>"
PREDICTIONS = f"array<struct<model_version:string,score:double,result:{RESULTS}>>"
ANNOTATIONS = f"array<struct<id:bigint,result:{RESULTS}>>"
TASK = f"data {DATA}, predictions {PREDICTIONS}, annotations {ANNOTATIONS}"

_MARKERS = fv.MARKER_LABELS


def _standard() -> Column:
    return F.array(*[F.lit(x) for x in fv.STANDARD_LABELS])


def is_standard(label: Column) -> Column:
    return F.array_contains(_standard(), label)


def _or_empty(values: Column, ddl: str) -> Column:
    return F.coalesce(values, F.array().cast(ddl))


def normalize_simplified(samples: DataFrame) -> DataFrame:
    """Profile records of samples with ``text, privacy_mask, coreferences, language, country``."""
    mask = _or_empty(F.col("privacy_mask"), MASK)
    known = F.filter(mask, lambda e: is_standard(e["label"]))
    clusters = F.coalesce(F.size("coreferences"), F.lit(0))
    clusters = F.when(clusters < 0, 0).otherwise(clusters)
    kept = [c for c in samples.columns
            if c not in ("text", "privacy_mask", "coreferences", "language", "country")]
    return samples.select(
        *kept,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("country", F.lit("unknown")).alias("country"),
        F.transform(known, lambda e: e["label"]).alias("labels"),
        F.transform(
            F.filter(mask, lambda e: F.coalesce(e["label"], F.lit("")) != ""), lambda e: e["label"]
        ).alias("all_labels"),
        F.transform(
            F.filter(known, lambda e: F.coalesce(e["value"], F.lit("")) != ""),
            lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value")),
        ).alias("entities"),
        F.size(known).alias("entity_count"),
        clusters.alias("coref_cluster_count"),
        (clusters > 0).alias("has_coreferences"),
    )


def first_results(precedence: str) -> Column:
    """The result list of the first prediction or annotation, in the given order of preference."""
    sources = {"predictions": ("predictions", "annotations"), "annotations": ("annotations", "predictions")}
    first, second = sources[precedence]

    def of(name: str) -> Column:
        return F.get(F.col(name), F.lit(0))["result"]

    return _or_empty(
        F.when(F.size(first) > 0, of(first)).when(F.size(second) > 0, of(second)), RESULTS
    )


def normalize_task(tasks: DataFrame) -> DataFrame:
    """Profile records of annotation tasks: predictions first, all labels of an entry count."""
    results = first_results("predictions")
    kept = [c for c in tasks.columns if c not in ("data", "predictions", "annotations")]
    rows = tasks.withColumn("_r", results)
    labelled = F.filter("_r", lambda r: r["type"] == "labels")
    pairs = F.flatten(
        F.transform(
            labelled,
            lambda r: F.transform(
                F.coalesce(r["value"]["labels"], F.array().cast("array<string>")),
                lambda label: F.struct(label.alias("label"), r["value"]["text"].alias("value")),
            ),
        )
    )
    targets = F.array_distinct(
        F.filter(
            F.transform(F.filter("_r", lambda r: r["type"] == "relation"), lambda r: r["to_id"]),
            lambda t: F.coalesce(t, F.lit("")) != "",
        )
    )
    rows = rows.withColumn("_p", pairs).withColumn("_t", F.size(targets))
    known = F.filter("_p", lambda p: is_standard(p["label"]))
    return rows.select(
        *kept,
        F.coalesce("data.text", F.lit("")).alias("text"),
        F.coalesce("data.language", F.lit("unknown")).alias("language"),
        F.coalesce("data.country", F.lit("unknown")).alias("country"),
        F.transform(known, lambda p: p["label"]).alias("labels"),
        F.transform("_p", lambda p: p["label"]).alias("all_labels"),
        F.filter(known, lambda p: F.coalesce(p["value"], F.lit("")) != "").alias("entities"),
        F.size(known).alias("entity_count"),
        F.col("_t").alias("coref_cluster_count"),
        (F.col("_t") > 0).alias("has_coreferences"),
    )


def _mask_of(results: Column, keep) -> Column:
    return F.transform(
        F.filter(results, keep),
        lambda r: F.struct(
            F.coalesce(r["value"]["text"], F.lit("")).alias("value"),
            F.get(r["value"]["labels"], F.lit(0)).alias("label"),
            r["value"]["start"].alias("start"),
            r["value"]["end"].alias("end"),
        ),
    )


def task_to_sample(tasks: DataFrame) -> DataFrame:
    """Simplified samples for review: annotations first, first label only, language English."""
    kept = [c for c in tasks.columns if c not in ("data", "predictions", "annotations")]
    mask = _mask_of(
        first_results("annotations"),
        lambda r: (r["type"] == "labels") & (F.coalesce(F.size(r["value"]["labels"]), F.lit(0)) > 0),
    )
    return tasks.select(
        *kept,
        F.coalesce("data.text", F.lit("")).alias("text"),
        mask.alias("privacy_mask"),
        F.coalesce("data.language", F.lit("English")).alias("language"),
        F.col("data.country").alias("country"),
    )


def to_training_format(tasks: DataFrame, precedence: str = "annotations") -> DataFrame:
    """Training samples with an ``outcome`` of ok, no_text, no_annotation; markers are dropped."""
    kept = [c for c in tasks.columns if c not in ("data", "predictions", "annotations")]
    results = first_results(precedence)
    mask = _mask_of(
        F.col("_r"),
        lambda r: r["value"].isNotNull()
        & (F.coalesce(F.get(r["value"]["labels"], F.lit(0)), F.lit("")) != "")
        & ~F.get(r["value"]["labels"], F.lit(0)).isin(*_MARKERS),
    )
    outcome = (
        F.when(F.coalesce("data.text", F.lit("")) == "", "no_text")
        .when(F.size("_r") == 0, "no_annotation")
        .otherwise("ok")
    )
    return tasks.withColumn("_r", results).select(
        *kept, F.col("data.text").alias("text"), mask.alias("privacy_mask"),
        F.col("data.language").alias("language"), F.col("data.country").alias("country"),
        outcome.alias("outcome"),
    )


def has_non_standard(mask: str = "privacy_mask") -> Column:
    allowed = F.array(*[F.lit(x) for x in [*fv.STANDARD_LABELS, *_MARKERS]])
    return F.exists(
        mask,
        lambda e: (F.coalesce(e["label"], F.lit("")) != "")
        & ~F.array_contains(allowed, F.coalesce(e["label"], F.lit(""))),
    )


def drop_non_standard_samples(samples: DataFrame) -> DataFrame:
    """Without every sample that has a label outside the standard and marker sets."""
    return samples.where(~has_non_standard())


def remap_labels(mask: Column, mapping: dict[str, str] = fv.FOREIGN_LABELS) -> Column:
    """Foreign labels to ours; entities without a counterpart go."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.filter(
        F.transform(
            mask,
            lambda e: F.struct(
                e["value"].alias("value"), F.try_element_at(entries, e["label"]).alias("label"),
                e["start"].alias("start"), e["end"].alias("end"),
            ),
        ),
        lambda e: e["label"].isNotNull(),
    )


def place_entities(text: Column, mask: Column) -> Column:
    """Entities whose text is at their offsets; without offsets the first occurrence."""

    def placed(e: Column) -> Column:
        at = F.position(e["value"], text)
        given = e["start"].isNotNull() & e["end"].isNotNull()
        right = F.substring(text, e["start"] + 1, e["end"] - e["start"]) == e["value"]
        return F.when(
            given & right,
            F.struct(e["value"].alias("value"), e["label"].alias("label"),
                     e["start"].alias("start"), e["end"].alias("end")),
        ).when(
            ~given & (at > 0),
            F.struct(e["value"].alias("value"), e["label"].alias("label"),
                     (at - 1).alias("start"), (at - 1 + F.length(e["value"])).alias("end")),
        )

    return F.filter(F.transform(mask, placed), lambda e: e.isNotNull())


def import_foreign(rows: DataFrame) -> DataFrame:
    """Simplified samples of foreign rows (source_text, privacy_mask, language).

    Samples without text or without any mapped, placed entity go.
    """
    kept = [c for c in rows.columns if c not in ("source_text", "privacy_mask", "language")]
    mask = place_entities(F.col("source_text"), remap_labels(F.col("privacy_mask")))
    out = rows.select(
        *kept, F.col("source_text").alias("text"), F.explode_outer(F.array(mask)).alias("privacy_mask"),
        F.coalesce("language", F.lit("English")).alias("language"),
        F.lit(None).cast("string").alias("country"),
    )
    return out.where((F.coalesce("text", F.lit("")) != "") & (F.size("privacy_mask") > 0))


def occurrences(df: DataFrame, text: str, value: str, whole_words: bool = False) -> DataFrame:
    """Add ``positions``: all starts of ``value``, overlapping ones included, or whole words."""
    if whole_words:
        found = F.transform(find_word(F.col(text), F.col(value)), lambda m: m["start"])
    else:
        found = find_value(F.col(text), F.col(value))
    return df.withColumn("positions", found)


def _label_entry(number: Column, start: Column, value: Column, label: Column) -> Column:
    return F.struct(
        F.concat(F.lit("ent-"), number.cast("string")).alias("id"),
        F.lit("entities").alias("from_name"), F.lit("text").alias("to_name"),
        F.lit("labels").alias("type"),
        F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"),
            F.array(label).alias("labels"),
        ).alias("value"),
        F.lit(None).cast("string").alias("from_id"), F.lit(None).cast("string").alias("to_id"),
        F.lit(None).cast("string").alias("direction"),
    )


def claims_sql(text: str, mask: str) -> str:
    """SQL text of the claims (i, at, value, label) of mask entries, in mask order.

    Every distinct value is searched once. Its n-th entry claims its n-th start, unless another value
    has a start in common with it; only entries of such values are handed out one after the other.
    """
    entries = f"transform({mask}, (e, i) -> named_struct('value', e.value, 'i', i, 'label', e.label))"
    groups = groups_sql(f"array_sort({entries})", "NOT (get(xs, i).value <=> get(xs, i - 1).value)")
    placed = (
        f"transform({groups}, g -> named_struct('value', get(g, 0).value, 'entries', g, "
        f"'spots', {bind('get(g, 0).value', 'v', spots_sql(text, 'v'))}))"
    )
    starts = "array_sort(flatten(transform(placed, p -> transform(p.spots, s -> named_struct('at', s, 'value', p.value)))))"
    disputed = (
        "array_distinct(transform(filter(starts, (s, i) -> get(starts, i - 1).at = s.at OR get(starts, i + 1).at = s.at), "
        "s -> s.value))"
    )
    claim = "array<struct<i:int,at:int,value:string,label:string>>"
    free = (
        "flatten(transform(filter(placed, p -> NOT coalesce(array_contains(disputed, p.value), false)), p -> "
        "transform(p.entries, (e, k) -> named_struct('i', e.i, 'at', get(p.spots, k), 'value', e.value, 'label', e.label))))"
    )
    queue = (
        "array_sort(flatten(transform(filter(placed, p -> array_contains(disputed, p.value)), p -> transform(p.entries, "
        "e -> named_struct('i', e.i, 'value', e.value, 'label', e.label, 'spots', p.spots)))))"
    )
    step = bind(
        "get(filter(e.spots, s -> NOT array_contains(acc.used, s)), 0)", "at",
        "CASE WHEN at IS NULL THEN acc ELSE named_struct('used', concat(acc.used, array(at)), 'out', concat(acc.out, array("
        "named_struct('i', e.i, 'at', at, 'value', e.value, 'label', e.label)))) END",
    )
    in_turn = (
        f"aggregate({queue}, named_struct('used', {empty('array<int>')}, 'out', {empty(claim)}), (acc, e) -> {step}, acc -> acc.out)"
    )
    return bind(
        placed, "placed",
        bind(starts, "starts", bind(disputed, "disputed", f"array_sort(filter(concat({free}, {in_turn}), c -> c.at IS NOT NULL))")),
    )


def claimed_entities(text: Column, mask: Column) -> Column:
    """Label entries in mask order; every value claims its first start that is still free."""
    claims = let_sql(F.struct(text.alias("t"), mask.alias("m")), claims_sql("x.t", "x.m"))
    return F.transform(claims, lambda c, k: _label_entry(k + 1, c["at"], c["value"], c["label"])).cast(RESULTS)


def to_annotation_task(samples: DataFrame) -> DataFrame:
    """Annotation tasks of samples without coreferences; expressions only."""
    return samples.withColumn(
        "predictions",
        F.array(
            F.struct(
                F.lit("reviewed-v1").alias("model_version"), F.lit(1.0).alias("score"),
                claimed_entities(F.col("text"), F.col("privacy_mask")).alias("result"),
            )
        ).cast(PREDICTIONS),
    )


def infer_mention_type(mention: Column) -> Column:
    return F.when(F.lower(mention).isin(*fv.PRONOUNS), "pronoun").otherwise("reference")


def normalize_mentions(mentions: Column) -> Column:
    """VARIANT list of bare strings or objects to ARRAY of (text, type, privacy_mask_labels)."""
    items = F.try_variant_get(mentions, "$", "array<variant>")

    def one(m: Column) -> Column:
        bare = F.schema_of_variant(m) == "STRING"
        text = F.when(bare, F.try_variant_get(m, "$", "string")).otherwise(
            F.try_variant_get(m, "$.text", "string")
        )
        return F.struct(
            text.alias("text"),
            F.coalesce(F.when(~bare, F.try_variant_get(m, "$.type", "string")), infer_mention_type(text)).alias("type"),
            F.when(~bare, F.try_variant_get(m, "$.privacy_mask_labels", "array<string>")).alias(
                "privacy_mask_labels"
            ),
        )

    return F.transform(items, one)


#: Label of a mention by the type of its cluster, and how near an entity counts, in characters.
_CLUSTER_LABEL = {"person": "PRONOUN", "organization": "REFERENCE"}
_NEAR = 20

_LINKS = (
    "struct<entries:array<struct<value:string,at:int,labels:array<string>>>,keys:array<string>,used:array<int>,"
    "found:array<struct<value:string,id:int>>>"
)


def _mentions(text: Column, clusters: Column) -> Column:
    """Clusters as (label, mentions) with the starts of every mention."""

    def mention(m: Column) -> Column:
        return F.struct(
            m["text"].alias("value"),
            F.coalesce(m["privacy_mask_labels"], F.array().cast("array<string>")).alias("labels"),
            F.transform(find_word(text, m["text"]), lambda w: w["start"]).alias("spots"),
        )

    def cluster(c: Column) -> Column:
        kind = F.lower(F.coalesce(c["entity_type"], F.lit("")))
        label = F.lit("MENTION")
        for name, own in _CLUSTER_LABEL.items():
            label = F.when(kind == name, own).otherwise(label)
        mentions = F.coalesce(c["mentions"], F.array().cast(f"array<{MENTION}>"))
        return F.struct(label.alias("label"), F.transform(mentions, mention).alias("mentions"))

    return F.transform(F.coalesce(clusters.cast(CLUSTERS), F.array().cast(CLUSTERS)), cluster)


def _link_steps_sql(clusters: str) -> str:
    """Every start of every mention in order: those that may lie near an entity first, then all."""

    def steps(near: str) -> str:
        return (
            f"transform(m.spots, p -> named_struct('near', {near}, 'key', concat(p, ':', m.value), 'at', p, 'value', m.value, "
            "'head', CASE WHEN size(words) > 1 THEN concat(p, ':', get(words, 0)) END, 'label', c.label, 'labels', m.labels))"
        )

    both = f"concat(CASE WHEN size(m.labels) > 0 THEN {steps('true')} ELSE array() END, {steps('false')})"
    words = "filter(split(m.value, '\\\\s+'), w -> w <> '')"
    return f"flatten(transform({clusters}, c -> flatten(transform(c.mentions, m -> {bind(words, 'words', both)}))))"


def _linked_sql(claims: str, steps: str, near: str) -> str:
    """SQL text that folds the steps over the entities of the mask.

    A start that has an entry counts for it. A mention of several words whose first word has an entry,
    or one near an entity of its labels, gets an entry without a label; any other start that is still
    free gets one with the label of its cluster.
    """
    close = (
        f"exists({near}, n -> array_contains(s.labels, n.label) AND abs(n.at - s.at) < {_NEAR} "
        "AND array_contains(acc.keys, concat(n.at, ':', n.value)))"
    )
    act = (
        f"CASE WHEN s.near THEN CASE WHEN known = 0 AND {close} THEN 'bare' ELSE 'none' END WHEN known > 0 THEN 'known' "
        "WHEN s.head IS NOT NULL AND array_contains(acc.keys, s.head) THEN 'bare' "
        "WHEN NOT array_contains(acc.used, s.at) THEN 'label' ELSE 'none' END"
    )
    added = (
        "named_struct('entries', concat(acc.entries, array(named_struct('value', s.value, 'at', s.at, 'labels', "
        f"CASE WHEN act = 'label' THEN array(s.label) ELSE {empty('array<string>')} END))), "
        "'keys', concat(acc.keys, array(s.key)), 'used', CASE WHEN act = 'label' THEN concat(acc.used, array(s.at)) ELSE acc.used END, "
        "'found', concat(acc.found, array(named_struct('value', s.value, 'id', size(acc.keys) + 1))))"
    )
    counted = (
        "named_struct('entries', acc.entries, 'keys', acc.keys, 'used', acc.used, 'found', "
        "concat(acc.found, array(named_struct('value', s.value, 'id', CAST(known AS INT)))))"
    )
    step = bind(
        "array_position(acc.keys, s.key)", "known",
        bind(act, "act", f"CASE act WHEN 'none' THEN acc WHEN 'known' THEN {counted} ELSE {added} END"),
    )
    zero = (
        f"CAST(named_struct('entries', transform({claims}, c -> named_struct('value', c.value, 'at', c.at, 'labels', array(c.label))), "
        f"'keys', transform({claims}, c -> concat(c.at, ':', c.value)), 'used', transform({claims}, c -> c.at), "
        f"'found', {empty('array<struct<value:string,id:int>>')}) AS {_LINKS})"
    )
    return f"aggregate({steps}, {zero}, (acc, s) -> CAST({step} AS {_LINKS}))"


def _results_sql(links: str, clusters: str) -> str:
    """SQL text of the label entries, then of one relation per further mention of each cluster."""
    entry = (
        "named_struct('id', concat('ent-', i + 1), 'from_name', 'entities', 'to_name', 'text', 'type', 'labels', 'value', "
        "named_struct('start', e.at, 'end', e.at + length(e.value), 'text', e.value, 'labels', e.labels), "
        "'from_id', NULL, 'to_id', NULL, 'direction', NULL)"
    )
    counted = f"transform(filter({links}.found, f -> f.value = m.value), f -> f.id)"
    there = f"filter(transform(m.spots, p -> CAST(array_position({links}.keys, concat(p, ':', m.value)) AS INT)), k -> k > 0)"
    chain = f"flatten(transform(c.mentions, m -> CASE WHEN exists({links}.found, f -> f.value = m.value) THEN {counted} ELSE {there} END))"
    relation = (
        "named_struct('id', NULL, 'from_name', NULL, 'to_name', NULL, 'type', 'relation', 'value', NULL, "
        "'from_id', concat('ent-', other), 'to_id', concat('ent-', get(chain, 0)), 'direction', 'right')"
    )
    related = bind(chain, "chain", f"transform(slice(chain, 2, greatest(size(chain) - 1, 0)), other -> {relation})")
    return (
        f"concat(CAST(transform({links}.entries, (e, i) -> {entry}) AS {RESULTS}), "
        f"CAST(flatten(transform({clusters}, c -> {related})) AS {RESULTS}))"
    )


def link_coreferences(samples: DataFrame) -> DataFrame:
    """Annotation tasks of samples with ``coreferences``: label entries of the mask and of mentions, and
    relations from every further mention of a cluster to its first.

    Mentions are taken in order, and a start that one has taken is not free for the next. That order
    is kept by a fold inside the row, so there is no shuffle and no Python. Null texts have no entries.
    """
    out = samples.withColumn("_text", F.coalesce("text", F.lit("")))
    mask = F.coalesce(F.col("privacy_mask").cast(MASK), F.array().cast(MASK))
    claims = let_sql(F.struct(F.col("_text").alias("t"), mask.alias("m")), claims_sql("x.t", "x.m"))
    out = compute_once(out, "_claims", claims)
    out = compute_once(out, "_clusters", _mentions(F.col("_text"), F.col("coreferences")))
    # Only mentions that name labels look for entities near them.
    named = F.exists("_clusters", lambda c: F.exists(c["mentions"], lambda m: F.size(m["labels"]) > 0))
    spots = F.flatten(F.transform(mask, lambda e: F.transform(
        find_value(F.col("_text"), e["value"]),
        lambda p: F.struct(e["label"].alias("label"), e["value"].alias("value"), p.alias("at")),
    )))
    out = compute_once(out, "_near", F.when(named, spots).otherwise(F.array().cast("array<struct<label:string,value:string,at:int>>")))
    out = compute_once(out, "_steps", F.expr(_link_steps_sql("_clusters")))
    out = compute_once(out, "_links", F.expr(_linked_sql("_claims", "_steps", "_near")))
    return out.withColumn(
        "predictions",
        F.array(
            F.struct(
                F.lit("reviewed-v1").alias("model_version"), F.lit(1.0).alias("score"),
                F.expr(_results_sql("_links", "_clusters")).alias("result"),
            )
        ).cast(PREDICTIONS),
    ).drop("_text", "_claims", "_clusters", "_near", "_steps", "_links")


def attach_metadata(
    df: DataFrame, language: Column | None = None, country: Column | None = None,
    file_name: Column | None = None,
) -> DataFrame:
    """Fold text and metadata into ``data``; an explicit argument wins over the sample's column."""

    def pick(given: Column | None, name: str) -> Column:
        own = F.col(name) if name in df.columns else F.lit(None).cast("string")
        return (own if given is None else F.coalesce(given, own)).alias(name)

    data = F.struct(
        F.col("text"), pick(language, "language"), pick(country, "country"), pick(file_name, "file_name")
    )
    folded = ("text", "language", "country", "file_name", "privacy_mask", "coreferences")
    return df.withColumn("data", data).select(
        *[c for c in df.columns if c not in folded], "data"
    )
