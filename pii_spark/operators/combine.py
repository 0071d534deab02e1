"""One list of entities from rules, dictionaries and models."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import compute_once
from pii_spark.functions.spans import ENTITIES, ENTITY, merge_spans, no_entities
from pii_spark.operators.detect import RULES, Rule, check_threshold, detect_with_model, rule_entities
from pii_spark.operators.phrases import detect_phrases


def gather_entities(*detected: DataFrame, key: str = "doc_id", column: str = "found") -> DataFrame:
    """(key, array) of the entity rows of several detectors: one shuffle, of entities only.

    A group holds the entities of one text. Without detectors or rows the result is empty.
    """
    rows = reduce(DataFrame.unionByName, [d.select(key, F.struct(*_FIELDS).cast(ENTITY).alias("e")) for d in detected])
    return rows.groupBy(key).agg(F.collect_list("e").alias(column))


_FIELDS = ("text", "label", "start", "end", "confidence")


def combine_entities(
    *detected: DataFrame, key: str = "doc_id", threshold: float = fv.DEFAULT_THRESHOLD, policy: str = "confidence"
) -> DataFrame:
    """(key, entities) of texts in which any of the detectors found something.

    The spans of all detectors are swept in order of their start; a running maximum of the ends parts
    them into groups that overlap, and only spans of one group are compared, by ``policy``.
    """
    check_threshold(threshold)
    sure = [d.where(F.col("confidence") >= threshold) for d in detected]
    return gather_entities(*sure, key=key).select(key, merge_spans(F.col("found"), policy).alias("entities"))


def detect_combined(
    df: DataFrame,
    rules: Iterable[Rule] = RULES,
    gazetteer: DataFrame | None = None,
    load: Callable[[], Callable[[list[str]], list[list[dict]]]] | None = None,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    policy: str = "confidence",
    confidence: float = 0.6,
) -> DataFrame:
    """``df`` with the ``entities`` of rules, dictionary and model together, ready for ``mask_text``.

    Rules and the model work inside the row; with a model an ``error`` column tells where it failed.
    Dictionary hits come as rows and meet their text by ``key``, which should be unique. Overlaps of
    any two detectors are resolved once, over all their spans. Null texts have no entities.
    """
    check_threshold(threshold)
    out = df
    if load is not None:
        out = detect_with_model(out, load, text, entities="_model")
    parts = [rule_entities(F.coalesce(F.col(text), F.lit("")), rules)]
    if load is not None:
        parts.append(F.col("_model"))
    if gazetteer is not None:
        hits = detect_phrases(df.select(key, text), gazetteer, key, text, confidence)
        out = out.join(gather_entities(hits, key=key, column="_listed"), key, "left")
        parts.append(F.coalesce("_listed", no_entities()))
    sure = F.filter(F.concat(*[p.cast(ENTITIES) for p in parts]), lambda e: e["confidence"] >= threshold)
    return compute_once(out, "entities", merge_spans(sure, policy)).drop("_model", "_listed")
