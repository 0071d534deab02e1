"""Removal of word passages that occur more than once, by seed and extend."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pii_spark.llm.common import document_key, mixed, written

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` of the multiplier and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to each end, the same wherever the words stand."""
    power, inverse = _power(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def winnow(hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchors of a document: seed hash, first window, number of windows, place in the first window.

    Each window of ``length`` words chooses the seed (``seed`` words) with the smallest hash, the
    leftmost of equals. The choice depends on the words of the window alone, so equal windows choose
    equal seeds at equal places. Neighbouring windows with one choice make one anchor.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    n_seeds = len(hashes) - seed + 1
    seeds = np.zeros(n_seeds, np.uint64)
    for i in range(seed):
        seeds = seeds * np.uint64(_BASE) + hashes[i : n_seeds + i]
    seeds = mixed(seeds)
    views = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1)
    chosen = views.argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    counts = np.diff(first, append=n)
    return seeds[chosen[first]], first, counts, chosen[first] - first


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                hashes = word_hashes((text or b"").split())
                seeds, first, counts, place = winnow(hashes, length, seed)
                if len(first):
                    context = range_hashes(hashes, first, first + counts + length - 1)
                    found.append((seeds, context, np.full(len(first), key, np.int64), first, counts, place))
            if found:
                seeds, context, key, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
                columns = [_signed(seeds), _signed(context), pa.array(key), *(pa.array(c, pa.int32()) for c in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "context", "_doc", "first", "n", "place"])

    return run


def _open_windows(length: int):
    """Hashes of all windows of the anchors in ``_open``: one row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field("text").cast(pa.binary())
            lists = batch.column("_open")
            fields, offsets = lists.values, lists.offsets.to_numpy()
            seed, first, n, place, single = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            out = []
            for i, key in enumerate(batch.column("_doc").to_pylist()):
                own = np.arange(offsets[i], offsets[i + 1])
                hashes = word_hashes((texts[i].as_py() or b"").split())
                anchor = np.repeat(own, n[own])
                step = np.arange(len(anchor)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                starts = first[anchor] + step
                window = range_hashes(hashes, starts, starts + length)
                out.append((seed[anchor], place[anchor] - step, window.view(np.int64), np.full(len(anchor), key), starts, single[anchor]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            arrays = [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["seed", "left", "window", "_doc", "start", "single"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between them keeps its white space."""
    places = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for start, end in [*spans, (len(places), len(places))]:
        if start > at:
            left = 0 if at == 0 else places[at][0]
            right = len(text) if start == len(places) else places[start - 1][1]
            parts.append(text[left:right])
        at = end
    return b" ".join(parts)


def _cut(columns: list[str], single_spaces: bool):
    def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
        words = text.split()
        removed = sum(end - start for start, end in spans)
        if not single_spaces:
            return kept_text(text, spans) if spans else text, len(words), removed
        for start, end in reversed(spans):
            del words[start:end]
        return b" ".join(words), len(words) + removed, removed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            texts = row.field("text").cast(pa.binary()).to_pylist()
            spans = [merged([(s["start"], s["end"]) for s in one or []]) for one in batch.column("_spans").to_pylist()]
            made = [cut(t or b"", s) for t, s in zip(texts, spans, strict=True)]
            text = pa.array([None if t is None else m[0] for t, m in zip(texts, made, strict=True)], pa.binary())
            arrays = [text.cast(pa.string()) if c == "text" else row.field(c) for c in columns]
            arrays += [
                pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in one] for one in spans],
                         pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_words", "n_removed", "spans"])

    return run


#: Columns that ``remove_repeats`` returns anew, beside ``text``.
MADE = ("n_words", "n_removed", "spans")


def remove_repeats(docs: DataFrame, length: int = 35, seed: int = 6, single_spaces: bool = False) -> DataFrame:
    """``docs`` without the words of passages that occur again, plus ``n_words, n_removed, spans``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, compared unchanged. A word goes if one of the windows of
    ``length`` words that cover it starts anywhere else as well, in the same document too; all
    occurrences go. ``spans`` are the maximal stretches that went, in words. Documents that lose
    nothing keep their text; elsewhere the kept stretches are joined by a space. With
    ``single_spaces`` the text is always the kept words, joined by one space.

    1. *Seed.* Each window chooses the ``seed`` words of smallest hash in it, its anchor. Equal windows
       choose equal anchors at equal places, so only anchors with a seed that occurs twice can belong
       to a repeat.
    2. *Extend, whole contexts.* The context of an anchor is all words of all windows that chose it.
       Occurrences with equal contexts are repeats to both ends. One group-by extends a group of any
       number of copies, and no pairs arise.
    3. *Extend, contexts that differ.* That happens at the ends of a repeat. One occurrence per context
       is extended over every reach to the left: two of them match where the words of a window agree.
    4. Overlapping windows merge to maximal repeats, which are cut from the texts.

    Seeds, contexts and windows are compared by hash within the group of one seed hash, so two of them
    are taken for equal with a chance of about 2**-128 for each pair of different ones.

    Null and empty texts and those of fewer than ``length`` words lose nothing; null texts stay null.
    A repeated row is another occurrence of its passages, also if it repeats the id; rows that repeat
    an id should repeat the text. An empty table gives an empty result. Extra columns pass through.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), document_key().alias("_doc"))
    anchors = written(
        docs.select(document_key().alias("_doc"), "text").mapInArrow(
            _anchors(length, seed), "seed long, context long, _doc long, first int, n int, place int"
        ),
        "anchors",
    )
    # Written, so that both sides of the joins are plain exchanges, whose hot keys adaptive execution can split.
    twice = written(anchors.groupBy("seed").agg(F.count("*").alias("_c")).where("_c > 1").select("seed"), "repeated-seeds")
    candidates = written(anchors.join(twice, "seed", "left_semi"), "anchor-candidates")

    context = ["seed", "context", "n", "place"]
    classes = written(
        candidates.groupBy(*context).agg(F.count("*").alias("_c"), F.min(F.struct("_doc", "first")).alias("_one")), "contexts"
    )
    same = candidates.join(classes.where("_c > 1").select(*context), context, "left_semi").select(
        "_doc", F.col("first").alias("start"), (F.col("first") + F.col("n") + (length - 1)).alias("end")
    )

    several = classes.groupBy("seed").agg(F.count("*").alias("_k"), F.min("_c").alias("_least")).where("_k > 1 AND _least = 1")
    open_anchors = (
        classes.join(several.select("seed"), "seed", "left_semi")
        .select(F.col("_one._doc").alias("_doc"), F.struct(
            "seed", F.col("_one.first").alias("first"), "n", "place", (F.col("_c") == 1).alias("single")).alias("_a"))
        .groupBy("_doc").agg(F.collect_list("_a").alias("_open"))
    )
    # The anchors of one document bound the list. The exchange of the texts by document is planned once
    # and reused by the two readings of ``windows`` and by the last join.
    windows = whole.join(open_anchors, "_doc").select("_row", "_doc", "_open").mapInArrow(
        _open_windows(length), "seed long, left int, window long, _doc long, start int, single boolean"
    )
    window = ["seed", "left", "window"]
    agreeing = windows.groupBy(*window).agg(F.count("*").alias("_c"), F.max("single").alias("_s")).where("_c > 1 AND _s")
    edges = windows.where("single").join(agreeing.select(*window), window, "left_semi").select(
        "_doc", "start", (F.col("start") + length).alias("end")
    )
    spans = same.unionByName(edges).groupBy("_doc").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))

    columns = [c for c in docs.columns if c not in MADE]
    schema = T.StructType([
        *(docs.schema[c] for c in columns),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    return whole.join(spans, "_doc", "left").select("_row", "_doc", "_spans").mapInArrow(_cut(columns, single_spaces), schema)
