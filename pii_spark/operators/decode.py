"""From stored model scores to spans.

A chunk row is (key, chunk_ix, shift, text, tokens ARRAY<STRUCT<text,start,end>>, logits
ARRAY<FLOAT>): at most 512 tokens and only their piece of the text, with offsets relative to
``shift``, and their scores token by token in one array. Every row is small, however long the whole
text is, and rows are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import bind, let, let_sql, text_literal
from pii_spark.functions.spans import ENTITIES, code_points, entity, merge_spans, trim_bounds
from pii_spark.operators.detect import check_threshold


def chunk_starts(n: Column, max_len: int = fv.MAX_TOKENS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """First token of every chunk: one chunk up to ``max_len`` tokens, then a fixed stride until a
    chunk reaches the last token."""
    if overlap >= max_len:
        raise ValueError("overlap must be smaller than max_len")
    stride = max_len - overlap
    last = F.greatest(F.ceil((n - max_len) / stride), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)


def chunk_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokens: str = "tokens",
    max_len: int = fv.MAX_TOKENS, overlap: int = fv.CHUNK_OVERLAP, parallel: tuple[str, ...] = (),
) -> DataFrame:
    """One row per chunk: (key, chunk_ix, first_token, shift, text, tokens) and the chunk's part of
    the ``parallel`` arrays, which hold one element per token.

    ``text`` is the chunk's piece plus the character after it, which trimming looks at.
    """
    starts = chunk_starts(F.size(tokens), max_len, overlap)
    pieces = F.transform(
        starts,
        lambda s: let(
            F.slice(F.col(tokens), s + 1, F.lit(max_len)),
            lambda ts: F.struct(
                s.alias("first_token"),
                F.coalesce(F.get(ts, F.lit(0))["start"], F.lit(0)).alias("shift"),
                F.coalesce(F.get(ts, F.size(ts) - 1)["end"], F.lit(0)).alias("reach"),
                ts.alias("ts"),
            ),
        ),
    )
    cut = F.transform(
        pieces,
        lambda p: F.struct(
            p["first_token"], p["shift"],
            *[F.slice(F.col(c), p["first_token"] + 1, F.lit(max_len)).alias(c) for c in parallel],
            F.substring(F.col(text), p["shift"] + 1, p["reach"] - p["shift"] + 1).alias("text"),
            F.transform(
                p["ts"],
                lambda t: F.struct(
                    t["text"].alias("text"), (t["start"] - p["shift"]).alias("start"),
                    (t["end"] - p["shift"]).alias("end"),
                ),
            ).alias("tokens"),
        ),
    )
    return df.select(key, F.posexplode_outer(cut).alias("chunk_ix", "c")).where(
        F.col("chunk_ix").isNotNull()
    ).select(key, "chunk_ix", "c.*")


def softmax(logits: Column) -> Column:
    """Probabilities of one score vector, max-shifted."""
    def of(xs: Column) -> Column:
        top = F.array_max(xs)
        return let(
            F.transform(xs, lambda x: F.exp(x.cast("double") - top.cast("double"))),
            lambda es: let(
                F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e), lambda s: F.transform(es, lambda e: e / s)
            ),
        )

    return let(logits, of)


def top_labels(logits: Column, labels: list[str], k: int = 3) -> Column:
    """The ``k`` most probable labels of one token; the lower id wins a tie."""
    names = F.array(*[F.lit(x) for x in labels])
    ranked = let(
        softmax(logits),
        lambda ps: F.array_sort(F.transform(ps, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))),
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(F.get(names, r["i"]).alias("label"), (-r["m"]).alias("probability")),
    )


def viterbi(
    scores: list[np.ndarray], transitions: np.ndarray, start: np.ndarray, end: np.ndarray
) -> list[np.ndarray]:
    """Best label path of every sequence, all sequences at once; the lowest label id wins a tie."""
    lengths = np.array([len(s) for s in scores])
    steps, labels = int(lengths.max(initial=0)), len(start)
    if steps == 0:
        return [np.zeros(0, dtype=np.int64) for _ in scores]
    padded = np.zeros((steps, len(scores), labels))
    for i, s in enumerate(scores):
        padded[: len(s), i] = s
    best = start + padded[0]
    back = np.zeros((steps, len(scores), labels), dtype=np.int32)
    for t in range(1, steps):
        arrive = best[:, :, None] + transitions + padded[t][:, None, :]
        back[t] = arrive.argmax(axis=1)
        best = np.where((t < lengths)[:, None], arrive.max(axis=1), best)
    paths = np.zeros((steps, len(scores)), dtype=np.int64)
    current = (best + end).argmax(axis=1)
    everyone = np.arange(len(scores))
    for t in range(steps - 1, -1, -1):
        paths[t] = current
        if t > 0:
            current = np.where(t < lengths, back[t][everyone, current], current)
    return [paths[: len(s), i] for i, s in enumerate(scores)]


_TOGETHER = 64  # sequences per Viterbi run; bounds its memory


def decode_logits(chunks: DataFrame, labels: list[str], crf: dict | None = None) -> DataFrame:
    """Add ``decoded``, a (tag, confidence) per token: Viterbi over ``crf`` (transitions, start, end) or argmax.

    Python returns two arrays a chunk; the tags get their names inside Spark.

    The CRF tables are a few thousand numbers and travel with the function. ``logits`` should be a
    stored column: Spark does not run a Python function on an expression with nested lambdas.
    """
    tables = None
    if crf is not None:
        tables = tuple(np.asarray(crf[k], dtype=np.float64) for k in ("transitions", "start", "end"))
    width = len(labels)

    @F.pandas_udf("struct<path:array<int>,confidence:array<double>>")
    def decode(logits: pd.Series) -> pd.DataFrame:
        found, sure = [], []
        for first in range(0, len(logits), _TOGETHER):
            some = [
                np.asarray([] if x is None else x, dtype=np.float64).reshape(-1, width)
                for x in logits.iloc[first : first + _TOGETHER]
            ]
            paths = [s.argmax(axis=1) for s in some] if tables is None else viterbi(some, *tables)
            for scores, path in zip(some, paths):
                weights = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf))
                found.append(path.astype(np.int32))
                sure.append(weights[np.arange(len(path)), path] / weights.sum(axis=1))
        return pd.DataFrame({"path": pd.Series(found, dtype=object), "confidence": pd.Series(sure, dtype=object)})

    names = f"array({', '.join(text_literal(t) for t in labels)})"
    named = (
        f"transform(_path.path, (k, i) -> named_struct('tag', get({names}, k), 'confidence', get(_path.confidence, i)))"
    )
    out = chunks.withColumn("_path", decode("logits"))
    return out.withColumn("decoded", F.expr(named)).drop("logits", "_path")


def _base(tag: Column) -> Column:
    return F.when(tag.startswith("B-") | tag.startswith("I-"), F.substring(tag, 3, 1000)).otherwise(tag)


def is_joiner(token: Column) -> Column:
    bare = F.trim(token, F.lit(" \t\n\r"))
    return (bare != "") & (F.translate(bare, fv.JOINER_CHARS, "") == "")


def group_spans(
    text: Column, tokens: Column, decoded: Column, threshold: float = fv.DEFAULT_THRESHOLD
) -> Column:
    """Entities of tagged tokens.

    Tags below the threshold count as O. A joiner token tagged O inside an entity continues it when
    the next token has the same label above the threshold; it adds the entity's own confidence. A
    same-label B continues only where it touches the previous token. Tokens of no length are skipped.
    """
    state = f"struct<label:string,start:int,end:int,confidence:double,done:{ENTITIES}>"

    def finished(acc: Column) -> Column:
        bounds = trim_bounds(text, acc["start"], acc["end"])
        return F.when(acc["label"].isNull(), acc["done"]).otherwise(
            let(
                bounds,
                lambda b: F.when(b["start"] >= b["end"], acc["done"]).otherwise(
                    F.concat(
                        acc["done"],
                        F.array(entity(code_points(text, b["start"], b["end"]), acc["label"], b["start"], b["end"], acc["confidence"])),
                    )
                ),
            )
        )

    def make(label: Column, start: Column, end: Column, confidence: Column, done: Column) -> Column:
        return F.struct(
            label.alias("label"), start.alias("start"), end.alias("end"),
            confidence.alias("confidence"), done.alias("done"),
        ).cast(state)

    def step(xs: Column, acc: Column, i: Column) -> Column:
        token, c = F.get(tokens, i), F.get(xs, i)["confidence"]
        own = F.when(c >= threshold, F.get(xs, i)["tag"]).otherwise(F.lit("O"))
        after, after_c = F.get(xs, i + 1)["tag"], F.get(xs, i + 1)["confidence"]
        bridged = (
            (own == "O") & acc["label"].isNotNull() & is_joiner(token["text"])
            & F.coalesce((after_c >= threshold) & (after != "O") & (_base(after) == acc["label"]), F.lit(False))
        )
        seen = F.struct(
            F.when(bridged, F.concat(F.lit("I-"), acc["label"])).otherwise(own).alias("tag"),
            F.when(bridged, acc["confidence"]).otherwise(c).alias("c"),
        )

        def consume(x: Column) -> Column:
            tag = x["tag"]
            named = tag != "O"
            same = F.coalesce(acc["label"] == _base(tag), F.lit(False)) & named
            goes_on = same & (tag.startswith("I-") | (token["start"] == acc["end"]))
            opens = named & (tag.startswith("B-") | acc["label"].isNull())
            none = F.lit(None).cast("string")
            return (
                F.when(goes_on, make(acc["label"], acc["start"], token["end"], (acc["confidence"] + x["c"]) / 2, acc["done"]))
                .when(opens, make(_base(tag), token["start"], token["end"], x["c"], finished(acc)))
                .otherwise(make(none, F.lit(0), F.lit(0), F.lit(0.0), finished(acc)))
            )

        return F.when(token["end"] <= token["start"], acc).otherwise(let(seen, consume))

    zero = make(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0.0), F.array().cast(ENTITIES))
    # Only tagged tokens and the token after each of them can change the state.
    tagged = f"(get(x.d, {{i}}).tag <> 'O' AND get(x.d, {{i}}).confidence >= {threshold}D)"
    real = "filter(sequence(0, size(x.d) - 1), i -> x.t[i].`end` > x.t[i].start)"
    near = bind(
        real, "ix",
        f"filter(ix, (i, k) -> {tagged.format(i='i')} OR coalesce({tagged.format(i='get(ix, k - 1)')}, false))",
    )
    visited = let_sql(
        F.struct(tokens.alias("t"), decoded.alias("d")),
        f"CASE WHEN exists(x.d, e -> e.tag <> 'O' AND e.confidence >= {threshold}D) THEN named_struct('d', x.d, 'ix', {near}) END",
    )
    return let(
        visited,
        lambda v: F.when(v.isNull(), F.array().cast(ENTITIES)).otherwise(
            F.aggregate(v["ix"], zero, lambda acc, i: step(v["d"], acc, i), finished)
        ),
    )


def decode_spans(
    chunks: DataFrame, labels: list[str], crf: dict | None = None, key: str = "doc_id",
    threshold: float = fv.DEFAULT_THRESHOLD, policy: str = "confidence",
) -> DataFrame:
    """(key, entities) of every text with chunks: decode and group per chunk, merge across the chunks.

    Only the found entities are shuffled to bring the chunks of a text together; they carry their own
    texts, so the texts themselves stay where they are.
    """
    check_threshold(threshold)
    local = group_spans(F.col("text"), F.col("tokens"), F.col("decoded"), threshold)
    shifted = F.transform(
        local,
        lambda e: entity(e["text"], e["label"], e["start"] + F.col("shift"), e["end"] + F.col("shift"), e["confidence"]),
    )
    found = (
        decode_logits(chunks, labels, crf)
        .select(key, "chunk_ix", shifted.alias("entities"))
        .groupBy(key)
        .agg(F.flatten(F.collect_list("entities")).alias("found"), F.count("*").alias("chunks"))
    )
    # A single chunk cannot overlap with another one and stays as it is.
    resolved = F.when(F.col("chunks") == 1, F.col("found").cast(ENTITIES)).otherwise(merge_spans(F.col("found"), policy))
    return found.select(key, resolved.alias("entities"))
