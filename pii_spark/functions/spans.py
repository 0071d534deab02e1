"""Expressions over one text and its ARRAY<STRUCT<text,label,start,end,confidence>> of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pii_spark.functions.dummies import dummy_sql
from pii_spark.functions.offsets import (
    bind,
    cut_sql,
    empty,
    find_value,
    let,
    let_sql,
    overlap_groups_sql,
    pages_sql,
    totals_sql,
)

ENTITY = "struct<text:string,label:string,start:int,end:int,confidence:double>"
ENTITIES = f"array<{ENTITY}>"


def entity(text: Column, label: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.struct(
        text.alias("text"),
        label.alias("label"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        confidence.cast("double").alias("confidence"),
    )


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


def code_points(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def merged_sql(spans: str, policy: str) -> str:
    """SQL text that folds spans, in a total order, into disjoint ones.

    Only spans of one overlap group meet in a fold.
    """
    if policy not in ("confidence", "longest"):
        raise ValueError(f"unknown policy: {policy}")

    def joined(confidence: str) -> str:
        return (
            "named_struct('text', concat(l.text, right(s.text, s.`end` - l.`end`)), 'label', l.label, "
            f"'start', l.start, 'end', s.`end`, 'confidence', {confidence})"
        )

    if policy == "confidence":
        best = "CASE WHEN s.confidence > l.confidence THEN s ELSE l END"
        resolved = (
            f"CASE WHEN s.start = l.start AND s.`end` = l.`end` THEN {best} "
            f"WHEN s.label = l.label AND s.`end` > l.`end` THEN {joined('(l.confidence + s.confidence) / 2')} "
            f"WHEN s.label = l.label THEN l ELSE {best} END"
        )
    else:
        resolved = (
            f"CASE WHEN s.label = l.label AND s.`end` > l.`end` THEN {joined('greatest(l.confidence, s.confidence)')} "
            "WHEN s.label = l.label THEN l "
            "WHEN s.`end` - s.start > l.`end` - l.start THEN s ELSE l END"
        )
    step = bind(
        "acc.last", "l",
        "CASE WHEN l IS NULL THEN named_struct('done', acc.done, 'last', s) "
        f"WHEN s.start < l.`end` THEN named_struct('done', acc.done, 'last', {resolved}) "
        "ELSE named_struct('done', concat(acc.done, array(l)), 'last', s) END",
    )
    keyed = (
        "transform(spans, s -> named_struct('a', s.start, 'b', -s.`end`, 'c', s.label, 'd', -s.confidence, 'span', s))"
    )
    zero = f"named_struct('done', {empty(ENTITIES)}, 'last', CAST(NULL AS {ENTITY}))"
    fold = f"aggregate(g, {zero}, (acc, s) -> {step}, acc -> concat(acc.done, array(acc.last)))"
    groups = overlap_groups_sql(f"transform(array_sort({keyed}), k -> k.span)")
    return bind(
        f"CAST(filter({spans}, s -> s.start < s.`end`) AS {ENTITIES})", "spans",
        "CASE WHEN size(spans) < 2 THEN spans "
        f"ELSE flatten(transform({groups}, g -> CASE WHEN size(g) = 1 THEN g ELSE {fold} END)) END",
    )


def merge_spans(spans: Column, policy: str = "confidence") -> Column:
    """Resolve overlaps into disjoint spans in text order.

    ``confidence``: identical spans and different labels keep the more confident one, equal labels
    are joined and their confidence averaged. ``longest``: equal labels are joined, of different
    labels the longer one stays. The text of a span is the one at its offsets.
    """
    return let_sql(spans, merged_sql("x", policy))


def trim_bounds(text: Column, start: Column, end: Column) -> Column:
    """STRUCT<start,end> without outer whitespace and one trailing sentence mark.

    The mark goes only when whitespace or the end of the text follows it. A second mark stays,
    since the first one now follows it.
    """
    blank = r"' \t\n\r'"
    follower = "substring(x.t, stop + 1, 1)"
    body = bind(
        "substring(x.t, x.s + 1, x.e - x.s)", "p",
        bind(
            f"trim(LEADING {blank} FROM p)", "tail",
            bind(
                "x.s + length(p) - length(tail)", "first",
                bind(
                    f"trim(TRAILING {blank} FROM tail)", "inner_text",
                    bind(
                        "first + length(inner_text)", "stop",
                        "named_struct('start', first, 'end', stop - CASE WHEN "
                        r"substring(inner_text, -1, 1) IN (',', '.', ';', ':', '!', '?') AND "
                        rf"{follower} IN ('', ' ', '\t', '\n', '\r') THEN 1 ELSE 0 END)",
                    ),
                ),
            ),
        ),
    )
    return let_sql(F.struct(text.alias("t"), start.alias("s"), end.alias("e")), body)


def dummies_sql(spans: str, salt: str = "") -> str:
    return (
        f"transform({spans}, s -> named_struct('text', s.text, 'label', s.label, 'start', s.start, 'end', s.`end`, "
        f"'confidence', s.confidence, 'dummy', {dummy_sql('s.label', 's.text', salt)}))"
    )


def with_dummies(spans: Column, salt: str = "") -> Column:
    """Add ``dummy`` to every span."""
    return let_sql(spans, dummies_sql("x", salt))


def replaced_sql(text: str, spans: str) -> str:
    """SQL text of ``replace_spans``."""
    valid = "(s.start >= 0 AND s.`end` <= whole.n AND s.start < s.`end`)"
    piece = f"concat({cut_sql('whole.pages', 'coalesce(get(placed, i - 1).`end`, 0)', 's.start')}, s.dummy)"
    by_place = bind(
        f"filter({spans}, s -> {valid})", "placed",
        f"CASE WHEN size(placed) = 0 THEN {text} ELSE concat(array_join(transform(placed, (s, i) -> {piece}), ''), "
        f"{cut_sql('whole.pages', 'element_at(placed, -1).`end`', 'whole.n')}) END",
    )
    first_hit = bind(
        "position(s.text, acc)", "p",
        "CASE WHEN p > 0 AND s.text <> '' THEN overlay(acc PLACING s.dummy FROM p FOR length(s.text)) ELSE acc END",
    )
    strays = f"aggregate(filter({spans}, s -> NOT {valid}), {by_place}, (acc, s) -> {first_hit})"
    measured = f"named_struct('n', length({text}), 'pages', {pages_sql(text)})"
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {bind(measured, 'whole', strays)} END"


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its ``dummy``.

    Spans with valid offsets must be disjoint and in text order. A span with invalid offsets
    replaces the first occurrence of its text instead.
    """
    return let_sql(F.struct(text.alias("t"), spans.alias("s")), replaced_sql("x.t", "x.s"))


def first_by_key_sql(items: str) -> str:
    """SQL text that keeps, of (key, value) structs with one key, the first; in the order of the array."""
    keyed = f"array_sort(transform({items}, (e, i) -> named_struct('key', e.key, 'i', i, 'value', e.value)))"
    firsts = (
        "transform(filter(xs, (x, j) -> j = 0 OR x.key <> get(xs, j - 1).key), "
        "x -> named_struct('i', x.i, 'key', x.key, 'value', x.value))"
    )
    return bind(keyed, "xs", f"transform(array_sort({firsts}), f -> named_struct('key', f.key, 'value', f.value))")


def mapping_sql(spans: str) -> str:
    """SQL text of ``masked_to_original``."""
    pairs = f"transform({spans}, s -> named_struct('key', s.dummy, 'value', s.text))"
    return f"map_from_entries({first_by_key_sql(pairs)})"


def masked_to_original(spans: Column) -> Column:
    """MAP dummy -> original; of several originals with one dummy the first in the text stays.

    Spans are read from the end of the text, and a later write to the map wins.
    """
    return let_sql(spans, mapping_sql("x"))


def longest_first(mapping: Column) -> Column:
    """Entries of a MAP<STRING,STRING>, longest key first, then by key."""
    return let_sql(
        mapping,
        "array_sort(transform(map_entries(x), e -> named_struct('k', -length(e.key), 'key', e.key, 'value', e.value)))",
    )


def restore_text(text: Column, mapping: Column) -> Column:
    """Replace every dummy in ``text`` by its original, longest dummy first."""
    entries = longest_first(mapping)
    both = F.struct(text.alias("t"), entries.alias("m"))
    return let_sql(
        both, "aggregate(filter(x.m, e -> e.key <> ''), x.t, (acc, e) -> replace(acc, e.key, e.value))"
    )


def restore_by_span(text: Column, spans: Column) -> Column:
    """Undo ``replace_spans`` on its unchanged output, by position; exact for any dummies."""
    # Lengths, which are not negative, are summed apart: the running totals work on those.
    before = "coalesce(get({}, i - 1), 0)"
    moved = bind(
        f"s.start + {before.format('new')} - {before.format('old')}", "at",
        "named_struct('text', s.dummy, 'start', at, 'end', at + length(s.dummy), 'dummy', s.text)",
    )
    body = bind(
        totals_sql("transform(x, s -> length(s.dummy))"), "new",
        bind(totals_sql("transform(x, s -> s.`end` - s.start)"), "old", f"transform(x, (s, i) -> {moved})"),
    )
    return let(let_sql(spans, body), lambda xs: replace_spans(text, xs))


def covered_characters(text: Column, values: Column) -> Column:
    """Number of characters inside any occurrence of any of the values."""
    ranges = F.flatten(
        F.transform(
            F.array_distinct(values),
            lambda v: F.transform(
                find_value(text, v),
                lambda p: F.struct(p.alias("start"), (p + F.length(v)).alias("end")),
            ),
        )
    )
    return let_sql(
        F.array_sort(ranges),
        "aggregate(x, named_struct('covered', 0, 'reach', 0), (acc, r) -> named_struct("
        "'covered', acc.covered + greatest(r.`end` - greatest(r.start, acc.reach), 0), "
        "'reach', greatest(acc.reach, r.`end`)), acc -> acc.covered)",
    )


def average_confidence(spans: Column) -> Column:
    return let_sql(
        spans,
        "CASE WHEN size(x) > 0 THEN aggregate(x, 0D, (acc, s) -> acc + s.confidence) / size(x) ELSE 0D END",
    )
