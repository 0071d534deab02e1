"""Comparing two annotations of the same files, and the ledger of reviewed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions.offsets import bind, groups_sql
from pii_spark.operators.normalize import is_standard

_ENTRY = "array<struct<value:string,label:string>>"


def diff_annotations(own: DataFrame, other: DataFrame, key: str = "file_name") -> DataFrame:
    """Issues of (key, privacy_mask) tables: key, issue_type, value, labels and detail.

    Per trimmed value: labels differ -> WRONG_LABEL for each own entry whose label the other side
    lacks; only ours -> EXTRA; only theirs -> MISSING. One join of whole masks per file; the
    comparison happens inside the row. Files known to only one side count as empty on the other.
    """

    def mask(df: DataFrame, name: str) -> DataFrame:
        entries = F.transform(
            "privacy_mask",
            lambda e: F.struct(F.trim(e["value"], F.lit(" \t\n\r")).alias("value"), e["label"].alias("label")),
        )
        return df.select(key, entries.alias(name))

    empty = F.array().cast(_ENTRY)
    both = mask(own, "a").join(mask(other, "b"), key, "full_outer").select(
        key, F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b")
    )

    # Entries of both sides with one value stand together; labels are compared inside such a group only.
    def entries(side: str) -> str:
        return f"transform({side}, (e, i) -> named_struct('value', e.value, 'side', '{side}', 'i', i, 'label', e.label))"

    def issue(kind: str, ours: str, theirs: str, detail: str) -> str:
        return (
            f"named_struct('side', e.side, 'i', e.i, 'issue', named_struct('issue_type', '{kind}', 'value', e.value, "
            f"'original_label', {ours}, 'suggested_label', {theirs}, 'detail', concat('\"', e.value, '\"', {detail})))"
        )

    none = "CAST(NULL AS STRING)"
    wrong = issue(
        "WRONG_LABEL", "e.label", "get(other, 0)", "': labeled ', e.label, ', second annotator suggests ', get(other, 0)"
    )
    extra = issue("EXTRA", "e.label", none, "' (', e.label, '): only in the first annotation'")
    missing = issue("MISSING", none, "e.label", "' (', e.label, '): only in the second annotation'")
    compared = bind(
        "transform(filter(g, e -> e.side = 'b'), e -> e.label)", "other",
        bind(
            "array_distinct(other)", "known",
            f"CASE WHEN size(other) = 0 THEN transform(g, e -> {extra}) "
            f"WHEN size(other) = size(g) THEN transform(g, e -> {missing}) "
            f"ELSE transform(filter(g, e -> e.side = 'a' AND NOT array_contains(known, e.label)), e -> {wrong}) END",
        ),
    )
    ordered = f"array_sort(concat({entries('a')}, {entries('b')}))"
    groups = groups_sql(ordered, "NOT (get(xs, i).value <=> get(xs, i - 1).value)")
    found = F.expr(f"transform(array_sort(flatten(transform({groups}, g -> {compared}))), e -> e.issue)")
    return both.select(key, found.alias("issues"))


def explode_issues(reviews: DataFrame, key: str = "file_name") -> DataFrame:
    return (
        reviews.select(key, F.explode_outer("issues").alias("i"))
        .where(F.col("i").isNotNull())
        .select(key, "i.*")
    )


def corrected_samples(reviews: DataFrame, second: DataFrame, texts: DataFrame, key: str = "file_name") -> DataFrame:
    """For files with issues, label entries rebuilt from the second annotation.

    Standard labels only, at the first occurrence; values that do not occur are dropped and ids are
    numbered over what remains.
    """
    dirty = reviews.where(F.size("issues") > 0).select(key)
    text = F.col("text")
    placed = F.filter(
        "privacy_mask",
        lambda e: is_standard(e["label"]) & (e["value"] != "") & F.contains(text, e["value"]),
    )
    entries = F.transform(
        placed,
        lambda e, i: F.struct(
            F.concat(F.lit("ent-"), (i + 1).cast("string")).alias("id"),
            (F.position(e["value"], text) - 1).alias("start"),
            (F.position(e["value"], text) - 1 + F.length(e["value"])).alias("end"),
            e["value"].alias("text"), e["label"].alias("label"),
        ),
    )
    return (
        second.select(key, "privacy_mask").join(dirty, key, "left_semi").join(texts.select(key, "text"), key)
        .select(key, "text", entries.alias("entries"))
    )


def skip_reviewed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return files.join(ledger.select("file_name").distinct(), "file_name", "left_anti")


def ledger_rows(reviews: DataFrame) -> DataFrame:
    """Ledger lines: status, count and the first five details of 80 characters."""
    shown = F.transform(F.slice("issues", 1, 5), lambda i: F.substring(i["detail"], 1, 80))
    return reviews.select(
        "file_name",
        F.when(F.size("issues") == 0, "CLEAN").otherwise("DIRTY").alias("status"),
        F.size("issues").alias("issue_count"),
        F.array_join(shown, "; ").alias("issues"),
    )


def merge_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """New lines replace old ones of the same file."""
    cols = ["file_name", "status", "issue_count", "issues"]
    kept = old.select(cols).join(new.select("file_name"), "file_name", "left_anti")
    return kept.unionByName(new.select(cols))


def audit_counts(reviews: DataFrame) -> DataFrame:
    """One row: audited, clean and dirty files with percentages."""
    total, dirty = F.count("*"), F.count_if(F.size("issues") > 0)

    def pct(n: Column) -> Column:
        return F.round(F.when(total > 0, 100.0 * n / total).otherwise(0.0), 1)

    return reviews.agg(
        total.alias("total"), (total - dirty).alias("clean"), dirty.alias("dirty"),
        pct(total - dirty).alias("clean_pct"), pct(dirty).alias("dirty_pct"),
    )


def issue_breakdown(issues: DataFrame, top_labels: int = 15) -> DataFrame:
    """Counts by issue type and, for the most affected labels, by label."""
    kinds = issues.groupBy(F.col("issue_type").alias("name")).agg(F.count("*").alias("n")).select(
        F.lit("issue_type").alias("section"), "name", "n"
    )
    label = F.coalesce("original_label", "suggested_label")
    labels = issues.groupBy(label.alias("name")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "name"
    ).limit(top_labels).select(F.lit("label").alias("section"), "name", "n")
    return kinds.unionByName(labels)


def noisiest_files(reviews: DataFrame, key: str = "file_name", n: int = 20) -> DataFrame:
    """Files with most issues and their counts by type."""
    def of(kind: str) -> Column:
        return F.size(F.filter("issues", lambda i: i["issue_type"] == kind)).alias(kind.lower())

    return (
        reviews.where(F.size("issues") > 0)
        .select(key, F.size("issues").alias("issue_count"), of("WRONG_LABEL"), of("EXTRA"), of("MISSING"))
        .orderBy(F.desc("issue_count"), key)
        .limit(n)
    )


def example_issues(reviews: DataFrame, key: str = "file_name", n: int = 30) -> DataFrame:
    """The first ``n`` issues, files with most issues first."""
    return (
        reviews.select(key, F.size("issues").alias("issue_count"), F.posexplode_outer("issues").alias("pos", "i"))
        .where(F.col("pos").isNotNull())
        .select(key, "issue_count", "pos", "i.issue_type", "i.detail")
        .orderBy(F.desc("issue_count"), key, "pos")
        .limit(n)
    )
