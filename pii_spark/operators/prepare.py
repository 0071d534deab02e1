"""Training data: tokens, BIO labels, class weights, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import (
    bind,
    compute_once,
    cut_sql,
    empty,
    find_matches,
    let,
    let_sql,
    overlap_groups_sql,
    pages_sql,
)
from pii_spark.functions.ranking import cut_lineage, mark_smallest

WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = WORD + r"|[^\p{L}\p{M}\p{N}_\s]"
TOKENS = "array<struct<text:string,start:int,end:int>>"
SPAN = "struct<value:string,label:string,start:int,end:int>"
_PAGE = 1024


def tokens_of(text: Column, pattern: str = TOKEN, limit: int | None = None) -> Column:
    """Tokens with offsets; training keeps the first ``limit``."""
    found = find_matches(text, pattern)
    return found if limit is None else F.slice(found, 1, limit)


def tokenize_offsets(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    return df.withColumn("tokens", tokens_of(F.col(text), limit=limit))


def check_mask_offsets(text: Column, mask: Column) -> Column:
    """Mask entries whose text is at their offsets; missing offsets are an error."""
    missing = "raise_error(concat('privacy mask entry without offsets: ', coalesce(e.value, '')))"
    given = f"transform(x.m, e -> CASE WHEN e.start IS NULL OR e.`end` IS NULL THEN CAST({missing} AS {SPAN}) ELSE e END)"
    checked = bind(pages_sql("x.t"), "pages", f"filter({given}, e -> {cut_sql('pages', 'e.start', 'e.`end`')} = e.value)")
    inputs = F.struct(text.alias("t"), mask.cast(f"array<{SPAN}>").alias("m"))
    return let_sql(inputs, f"CASE WHEN size(x.m) > 0 THEN {checked} ELSE x.m END")


def drop_overlaps(mask: Column) -> Column:
    """Disjoint spans, chosen longest first, then by start, then label; from the last to the first.

    A span is compared with the chosen ones of its overlap group only.
    """
    by_start = "transform(array_sort(transform(x, e -> named_struct('s', e.start, 'e', e))), k -> k.e)"
    longest_first = (
        "transform(array_sort(transform(g, e -> named_struct('k', e.start - e.`end`, 's', e.start, 'l', e.label, 'e', e))), k -> k.e)"
    )
    chosen = (
        f"aggregate({longest_first}, {empty(f'array<{SPAN}>')}, (acc, e) -> CASE WHEN exists(acc, y -> "
        "e.start < y.`end` AND y.start < e.`end`) THEN acc ELSE concat(acc, array(e)) END)"
    )
    kept = f"flatten(transform({overlap_groups_sql(by_start)}, g -> CASE WHEN size(g) = 1 THEN g ELSE {chosen} END))"
    last_first = f"sort_array(transform({kept}, e -> named_struct('s', e.start, 'e', e)), false)"
    return let_sql(
        mask.cast(f"array<{SPAN}>"), f"transform({last_first}, k -> k.e)"
    )


def best_entities(tokens: Column, mask: Column) -> Column:
    """Per token the span with the largest overlap, or null; ties go to the first span in order.

    Spans are laid out on pages of 1024 characters, so a token looks only at the spans near it and
    not at every span of its text.
    """
    ordered = F.transform(
        F.array_sort(
            F.transform(
                mask,
                lambda e: F.struct(e["start"].alias("s"), e["end"].alias("t"), e["label"].alias("l"), e.alias("e")),
            )
        ),
        lambda x: x["e"],
    )

    def page(p: Column) -> Column:
        return F.floor(p / _PAGE).cast("int")

    def pages(spans: Column) -> Column:
        last = page(F.array_max(F.transform(spans, lambda e: e["end"])))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.filter(spans, lambda e: (e["end"] > k * _PAGE) & (e["start"] < (k + 1) * _PAGE)),
        )

    def overlap(t: Column, e: Column) -> Column:
        return F.least(t["end"], e["end"]) - F.greatest(t["start"], e["start"])

    def best(t: Column, book: Column) -> Column:
        first, last = page(t["start"]), page(t["end"] - 1)
        near = F.when(first == last, F.get(book, first)).otherwise(
            F.flatten(F.slice(book, first + 1, last - first + 1))
        )
        return F.aggregate(
            F.coalesce(near, F.array().cast(f"array<{SPAN}>")),
            F.struct(F.lit(0).alias("n"), F.lit(None).cast(SPAN).alias("e")),
            lambda acc, e: F.when(
                overlap(t, e) > acc["n"], F.struct(overlap(t, e).alias("n"), e.cast(SPAN).alias("e"))
            ).otherwise(acc),
            lambda acc: acc["e"],
        )

    def bounds(spans: Column) -> Column:
        return F.struct(
            pages(spans).alias("book"), F.array_min(F.transform(spans, lambda e: e["start"])).alias("first"),
            F.array_max(F.transform(spans, lambda e: e["end"])).alias("last"),
        )

    # Tokens ahead of the first span and behind the last one need no look.
    def near(t: Column, b: Column) -> Column:
        return F.when((t["end"] > b["first"]) & (t["start"] < b["last"]), best(t, b["book"]))

    none = F.transform(tokens, lambda t: F.lit(None).cast(SPAN))
    return let(
        ordered,
        lambda spans: F.when(F.size(spans) == 0, none).otherwise(
            let(bounds(spans), lambda b: F.transform(tokens, lambda t: near(t, b)))
        ),
    )


def bio_labels(tokens: Column, mask: Column) -> Column:
    """BIO tag per token: empty tokens IGNORE, no span O, I if the previous token has the same span."""

    def tag(t: Column, e: Column, before: Column) -> Column:
        goes_on = F.coalesce(
            (before["start"] == e["start"]) & (before["end"] == e["end"]) & (before["label"] == e["label"]),
            F.lit(False),
        )
        return (
            F.when(t["end"] <= t["start"], F.lit("IGNORE"))
            .when(e.isNull(), F.lit("O"))
            .otherwise(F.concat(F.when(goes_on, "I-").otherwise("B-"), e["label"]))
        )

    def tagged(best: Column) -> Column:
        return F.transform(
            tokens,
            lambda t, i: tag(
                t, F.get(best, i),
                F.when(F.get(tokens, i - 1)["end"] > F.get(tokens, i - 1)["start"], F.get(best, i - 1)),
            ),
        )

    bare = F.transform(tokens, lambda t: F.when(t["end"] <= t["start"], "IGNORE").otherwise("O"))
    return let(
        mask, lambda spans: F.when(F.size(spans) == 0, bare).otherwise(let(best_entities(tokens, spans), tagged))
    )


def align_bio(
    df: DataFrame, text: str = "text", mask: str = "privacy_mask", limit: int | None = None, tags: str = "tags",
    tokens: str | None = None,
) -> DataFrame:
    """Add ``tokens`` and ``tags``; with ``tokens``, a column of them, the tags only.

    Row-local: neither tokens nor spans are shuffled. Two annotations of one text are aligned in one
    row, with the tokens of the first call.
    """
    spans = let(check_mask_offsets(F.col(text), F.col(mask)), drop_overlaps)
    if tokens is not None:
        return df.withColumn(tags, bio_labels(F.col(tokens), spans))
    both = let(
        tokens_of(F.col(text), limit=limit),
        lambda ts: F.struct(ts.alias("tokens"), bio_labels(ts, spans).alias("tags")),
    )
    out = compute_once(df, "_b", both)
    return out.withColumn("tokens", F.col("_b.tokens")).withColumn(tags, F.col("_b.tags")).drop("_b")


def label_vocabulary(spark) -> DataFrame:
    """(id, tag): O, then B and I of every label, and IGNORE."""
    tags = ["O"] + [f"{p}-{label}" for label in fv.STANDARD_LABELS for p in "BI"]
    rows = [*enumerate(tags), (fv.IGNORE_ID, "IGNORE")]
    return spark.createDataFrame(rows, "id int, tag string")


def tag_counts(tagged: DataFrame) -> DataFrame:
    tags = tagged.select(F.explode_outer("tags").alias("tag")).where(F.col("tag").isNotNull())
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def class_weights(tagged: DataFrame) -> DataFrame:
    """Weight per tag: sqrt(total / (classes * count)) over the mean of all entity tags; O is 1.

    The windows run over one row per tag, at most 53.
    """
    counts = tag_counts(tagged).where(F.col("tag") != "IGNORE")
    everything = W.partitionBy()
    raw = F.sqrt(F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))
    rows = counts.withColumn("w", F.when(F.col("tag") != "O", raw))
    mean = F.coalesce(F.avg("w").over(everything), F.lit(1.0))
    return rows.select(
        "tag", "n", F.round(F.when(F.col("tag") == "O", 1.0).otherwise(F.col("w") / mean), 6).alias("weight")
    )


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def split_size(total: Column, ratio: float) -> Column:
    """int(n * ratio), at least 1 and at most n - 1; 0 without a positive ratio."""
    if ratio <= 0:
        return F.lit(0)
    n = F.floor(total * ratio)
    return F.least(F.greatest(n, F.lit(1)), total - 1)


def split_random(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split`` (train or validation): exact size, stable under reruns."""
    marked = mark_smallest(df, hash_order(F.col(key), seed), lambda n: split_size(n, ratio), key)
    return marked.withColumn("split", F.when(F.col("chosen"), "validation").otherwise("train")).drop("chosen")


def entity_types(tags: Column) -> Column:
    """Distinct labels behind B and I tags."""
    return F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter(tags, lambda t: t.startswith("B-") | t.startswith("I-")),
                lambda t: F.substring(t, 3, 1000),
            )
        )
    )


def split_balanced(df: DataFrame, key: str, types: str = "types", ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Validation set that favours samples with rare labels; ``types`` lists a sample's labels.

    Every label nominates its round(count * ratio), at least one, rarest samples (rarity is the sum
    of 1 / label frequency). Nominated samples go first, by rarity; the rest is filled by hash. The
    sequential greedy selection has the same aim, but needs one task for all samples.

    Labels and nominations are checkpointed: the exact cuts read them several times.
    """
    slim = cut_lineage(df.select(key, types))
    pairs = slim.select(key, F.explode(types).alias("label"))
    freq = pairs.groupBy("label").agg(F.count("*").alias("f"))
    scored = pairs.join(freq, "label")
    # Equal label sets must give equal sums, so rarity is kept in whole billionths.
    unit = F.round(1e9 / F.col("f")).cast("bigint")
    rarity = scored.groupBy(key).agg(F.sum(unit).alias("rarity"))
    ranked = mark_smallest(
        scored.join(rarity, key),
        hash_order(F.col(key), seed),
        lambda n: F.greatest(F.lit(1), F.round(n * ratio)).cast("bigint"),
        key, by=["label"], first=-F.col("rarity"),
    )
    nominated = cut_lineage(
        slim.select(key).join(
            ranked.groupBy(key).agg(F.max("chosen").alias("nominated"), F.max("rarity").alias("rarity")),
            key, "left",
        )
    )
    order = F.when(F.coalesce("nominated", F.lit(False)), -F.col("rarity")).otherwise(F.lit(1))
    marked = mark_smallest(
        nominated,
        hash_order(F.col(key), seed), lambda n: split_size(n, ratio), key, first=order,
    )
    side = F.when(F.col("chosen"), "validation").otherwise("train").alias("split")
    return df.join(marked.select(key, side), key)


def cap_samples(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by hash order, exactly; all of them for n <= 0."""
    if n <= 0:
        return df
    marked = mark_smallest(df, hash_order(F.col(key), seed), lambda total: F.least(F.lit(n), total), key)
    return marked.where("chosen").drop("chosen")


def combine_sets(local: DataFrame, foreign: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Both sets with ``shuffle_key``, the order of the reshuffled whole."""
    both = local.unionByName(foreign, allowMissingColumns=True)
    return both.withColumn("shuffle_key", hash_order(F.col(key), seed))


def filter_by_ledger(df: DataFrame, ledger: DataFrame) -> DataFrame:
    clean = ledger.where(F.col("status") == "CLEAN").select("file_name").distinct()
    return df.join(clean, "file_name", "left_semi")


def load_report(samples: DataFrame) -> DataFrame:
    """Counts of a training load: ``outcome`` from the converter, plus the label check."""
    bad = (F.col("outcome") == "ok") & F.col("non_standard")
    return samples.agg(
        F.count("*").alias("available"),
        F.count_if((F.col("outcome") == "ok") & ~F.col("non_standard")).alias("processed"),
        F.count_if(bad).alias("non_standard"),
        F.count_if(F.col("outcome") != "ok").alias("conversion_errors"),
    )
