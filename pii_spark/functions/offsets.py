"""Character offsets of regular-expression matches, without a UDF and without a shuffle.

Offsets are 0-based code points, end exclusive. ``regexp_instr`` counts UTF-16 units, so offsets
come from the lengths of the matches and of the gaps between them.

Larger expressions are written as SQL text: one call builds what would take hundreds of calls
between Python and the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256

#: Characters of a page that a text is cut into.
_PAGE = 1024

MATCHES = "array<struct<text:string,start:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times.

    Inside lambdas a plain column reference may be inlined by the optimizer and evaluated once per
    element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """Like ``let``, with the body as SQL text over the variable ``x``."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is expensive to compute.

    A filter on a projected column is pushed below the projection, and the expression is then
    evaluated twice. Filters do not pass a generator, so the value comes out of a one-element one.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def bind(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once as ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def empty(ddl: str) -> str:
    return f"CAST(array() AS {ddl})"


_SUM, _MAXIMUM = "{a} + {b}", "greatest({a}, {b})"


def _scan(block: str, base: str, join: str) -> str:
    step = join.format(a="element_at(acc, -1)", b="v")
    return (
        f"aggregate({block}, array({base}), (acc, v) -> concat(acc, array({step})), "
        "acc -> slice(acc, 2, size(acc) - 1))"
    )


def _scanned_sql(values: str, join: str) -> str:
    """Running results of ``join`` over an INT array without negative values, from 0 on.

    A fold that appends to one growing array is quadratic. Folding within blocks, and over the results
    of the blocks, keeps the copying to a few hundred elements per element, also for very long texts.
    Every level of lambdas costs rounds of the analyzer, of which it has a hundred, so there is one
    level of blocks.
    """
    whole = f"transform(cut, b -> aggregate(b, 0, (acc, v) -> {join.format(a='acc', b='v')}))"
    blocks = (
        f"transform(sequence(0, CAST((size(items) - 1) div {_BLOCK} AS INT)), "
        f"k -> slice(items, k * {_BLOCK} + 1, {_BLOCK}))"
    )
    scans = f"flatten(transform(cut, (b, k) -> {_scan('b', 'coalesce(get(ahead, k - 1), 0)', join)}))"
    joined = bind(_scan(whole, "0", join), "ahead", scans)
    return bind(
        values, "items",
        f"CASE WHEN size(items) <= {_BLOCK} THEN {_scan('items', '0', join)} ELSE {bind(blocks, 'cut', joined)} END",
    )


def totals_sql(values: str) -> str:
    """Inclusive running sums of an INT array without negative values."""
    return _scanned_sql(values, _SUM)


def maxima_sql(values: str) -> str:
    """Inclusive running maxima of an INT array without negative values."""
    return _scanned_sql(values, _MAXIMUM)


def _cut_at(opens: str) -> str:
    return bind(
        f"CASE WHEN size(xs) > 0 THEN filter(sequence(0, size(xs) - 1), i -> i = 0 OR {opens}) "
        f"ELSE {empty('array<int>')} END",
        "at",
        "transform(at, (p, g) -> slice(xs, p + 1, coalesce(get(at, g + 1), size(xs)) - p))",
    )


def groups_sql(items: str, opens: str) -> str:
    """SQL text that cuts an array into runs; ``opens`` tells over ``xs`` and ``i`` where one begins.

    The first element always begins one. Elements are copied once.
    """
    return bind(items, "xs", _cut_at(opens))


def overlap_groups_sql(items: str) -> str:
    """SQL text that cuts spans (``start``, ``end``), sorted by start, where no earlier one reaches on.

    Spans of different groups cannot overlap, so work that compares spans stays inside a group.
    """
    reach = maxima_sql("transform(xs, s -> s.`end`)")
    return bind(items, "xs", bind(reach, "reach", _cut_at("get(xs, i).start >= get(reach, i - 1)")))


def pages_sql(text: str) -> str:
    """SQL text that cuts a text into pieces of ``_PAGE`` characters, in one pass."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_PAGE}}}', 0)"


def cut_sql(pages: str, start: str, end: str) -> str:
    """SQL text of the characters from ``start`` to ``end``; costs their number and at most two pages.

    ``substring`` of the whole text walks over all characters ahead, which adds up to the square of
    the length where a text is cut in many places. The bounds are evaluated several times.
    """
    a, b = (f"CAST(({x}) div {_PAGE} AS INT)" for x in (start, end))
    i, j = f"({start}) % {_PAGE}", f"({end}) % {_PAGE}"
    first, last = f"coalesce(get({pages}, {a}), '')", f"coalesce(get({pages}, {b}), '')"
    return (
        f"CASE WHEN ({end}) <= ({start}) THEN '' WHEN {a} = {b} THEN substring({first}, {i} + 1, {j} - {i}) "
        f"ELSE concat(substring({first}, {i} + 1), array_join(slice({pages}, {a} + 2, {b} - {a} - 1), ''), "
        f"substring({last}, 1, {j})) END"
    )


def running_totals(values: Column, short: bool = False) -> Column:
    """Inclusive running sums; ``short`` arrays of some dozens need no blocks."""
    return let_sql(values, _scan("x", "0", _SUM) if short else totals_sql("x"))


def located_sql(found: str, gaps: str) -> str:
    """Matches with offsets, from the match texts and the texts between them."""
    steps = f"zip_with({found}, slice({gaps}, 1, size({found})), (hit, gap) -> length(hit) + length(gap))"
    return bind(
        totals_sql(steps), "ends",
        f"transform({found}, (hit, i) -> named_struct('text', hit, 'start', ends[i] - length(hit), 'end', ends[i]))",
    )


def _matches_sql(text: str, regex: str) -> str:
    return bind(
        f"regexp_extract_all({text}, {regex}, 0)", "found",
        f"CASE WHEN size(found) > 0 THEN {located_sql('found', f'split({text}, {regex}, -1)')} "
        f"ELSE {empty(MATCHES)} END",
    )


def find_matches(text: Column, pattern: str | Column) -> Column:
    """ARRAY<STRUCT<text, start, end>> of all non-overlapping matches, in order.

    ``pattern`` must not match the empty string and must use non-capturing groups only. Texts
    without a match cost one regex pass.
    """
    if isinstance(pattern, str):
        return let_sql(text, _matches_sql("x", text_literal(pattern)))
    both = F.struct(text.alias("t"), pattern.alias("p"))
    return let_sql(both, _matches_sql("x.t", "x.p"))


def spots_sql(text: str, value: str) -> str:
    """SQL text of ``find_value``."""
    none = empty("array<int>")
    ahead = f"concat('(?=\\\\Q', replace({value}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E)')"
    starts = bind(totals_sql("transform(parts, part -> length(part))"), "ends", "slice(ends, 1, size(ends) - 1)")
    # A hit at the very start leaves no part ahead of it.
    found = bind(
        f"split({text}, {ahead}, -1)", "parts",
        f"concat(CASE WHEN startswith({text}, {value}) THEN array(0) ELSE {none} END, {starts})",
    )
    return f"CASE WHEN {value} <> '' AND contains({text}, {value}) THEN {found} ELSE {none} END"


def find_value(text: Column, value: Column) -> Column:
    """Start positions of ``value`` in ``text``; the search advances by one, so hits may overlap.

    The text is split ahead of every hit, and running totals of the parts give the starts, so one
    pass finds all of them.
    """
    return let_sql(F.struct(text.alias("t"), value.alias("v")), spots_sql("x.t", "x.v"))


def quoted(value: Column) -> Column:
    """``value`` as a literal inside a regular expression."""
    safe = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), safe, F.lit("\\E"))


def find_word(text: Column, value: Column) -> Column:
    """Matches of ``value`` as a whole word; if there is none, of its case variants."""
    exact = F.concat(F.lit("\\b"), quoted(value), F.lit("\\b"))
    any_case = find_matches(text, F.concat(F.lit("(?iu)"), exact))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast(MATCHES)).otherwise(
        let(
            find_matches(text, exact),
            lambda hits: F.when(F.size(hits) > 0, hits).otherwise(any_case),
        )
    )
