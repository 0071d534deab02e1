"""Maximal runs of repeated words in documents, found in tiles of every octave of periods.

A document is exploded into overlapping tiles, one row of tiles for each stretch of blocks and octave
of periods. Tiles are solved wherever the shuffle puts them: Z-functions on both sides of a block's
first boundary give, for every period of the octave, how far the words before and after it agree with
those one period later. Agreements that fill a block are fragments; a shuffle by document and period
brings them together, and overlapping ones are stitched to whole intervals.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pii_spark.llm.common import mixed, partitions, text_bytes, word_pieces, written

#: A run has at least ``MIN_WORDS`` words and ``MIN_TURNS`` periods.
MIN_WORDS, MIN_TURNS = 24, 3

#: Words of a block of the lowest octave. Its periods are 1 to 7: the 24 - q or more words that agree
#: with those q later hold a block that starts at a multiple of 8. The octave of periods m to 2m - 1
#: has blocks of m words, and the 2q or more agreeing words hold one of them.
LOWEST = 8

#: Words that the blocks of one row of tiles span at least, and rows of tiles in a batch.
STRETCH, ROWS = 1024, 256

_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def word_ids(text: bytes) -> np.ndarray:
    """The words of a text as numbers; equal words have equal ones."""
    known: dict[bytes, int] = {}
    ids = array("i")
    for piece in word_pieces(text, _SPACE):
        ids.extend([known.setdefault(w, len(known)) for w in piece.split()])
    return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, 0x9E3779B97F4A7C15, np.uint64)]))


def _octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """Words of a block, smallest and largest period of each octave in a text of ``n`` words."""
    if n >= MIN_WORDS:
        yield LOWEST, 1, LOWEST - 1
    m = LOWEST
    while m <= n // MIN_TURNS:
        yield m, m, min(2 * m - 1, n // MIN_TURNS)
        m *= 2


def candidates(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per octave: words of a block, smallest period, and the blocks and periods that may agree.

    Rolling fingerprints of blocks are compared with those one period later: equal words have equal
    fingerprints, so nothing is lost, and unequal words with equal ones are told apart in the tiles.
    """
    n = len(ids)
    if n < MIN_WORDS:
        return
    power = _powers(1 << (n - 1).bit_length())
    with np.errstate(over="ignore"):
        ahead = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:n])])
        for m, low, high in _octaves(n):
            prints = ahead[m:] - ahead[:-m]
            starts = prints[::m]
            blocks, periods = [], []
            if low < m:
                for q in range(low, high + 1):
                    later = prints[q::m]
                    hits = np.flatnonzero(later == starts[: len(later)] * power[q])
                    blocks.append(hits * m)
                    periods.append(np.full(len(hits), q))
            else:
                # Blocks by periods, some blocks at a time.
                step = max(1, (1 << 20) // m) * m
                for at in range(0, len(prints) - m, step):
                    later = prints[at + m : at + m + step]
                    rows = starts[at // m : at // m - (-len(later) // m)]
                    same = later == np.repeat(rows, m)[: len(later)] * np.tile(power[m : 2 * m], len(rows))[: len(later)]
                    hits = np.flatnonzero(same)
                    hits = hits[hits % m + m <= high]
                    blocks.append(at + hits // m * m)
                    periods.append(hits % m + m)
            yield m, low, np.concatenate([*blocks, np.zeros(0, np.int64)]), np.concatenate([*periods, np.zeros(0, np.int64)])


def _repeats_less(ids: np.ndarray, block: int, m: int, periods: np.ndarray) -> bool:
    """Whether all ``periods`` at a block are multiples of a smaller period of the words they span."""
    least, most = int(periods.min()), int(periods.max())
    d = int(np.gcd.reduce(periods)) if len(periods) > 1 else least // 2 if least % 2 == 0 else least
    end = block + most + m
    return d < least and np.array_equal(ids[block : end - d], ids[block + d : end])


def tile_rows(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, list[int]]]:
    """Rows of tiles that may hold a run: words of a block, smallest period, place of the first word, words, blocks.

    A tile reaches from one block before its own to four after its start. Neighbouring blocks share a row.
    """
    for m, low, blocks, periods in candidates(ids):
        if not len(blocks):
            continue
        order = np.argsort(blocks, kind="stable")
        blocks, periods = blocks[order], periods[order]
        own, first = np.unique(blocks, return_index=True)
        if low == m:
            groups = np.split(periods, first[1:])
            own = [b for b, q in zip(own.tolist(), groups, strict=True) if not _repeats_less(ids, b, m, q)]
        else:
            own = own.tolist()
        row: list[int] = []
        for b in [*own, None]:
            if row and (b is None or b - row[0] >= max(STRETCH, m) or b - row[-1] > 5 * m):
                at = max(0, row[0] - m)
                yield m, low, at, ids[at : row[-1] + 4 * m], row
                row = []
            if b is not None:
                row.append(b)


def z_function(words: array) -> array:
    """For every place, how many words from it on agree with the first ones."""
    n = len(words)
    z = array("i", bytes(4 * n))
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


@lru_cache(maxsize=100_000)
def _parts(q: int) -> tuple[int, ...]:
    """``q`` over each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        out.append(q // rest)
    return tuple(out)


def solve(m: int, low: int, at: int, words: array, blocks: list[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, from, to) of a row of tiles: words that agree with those a period later.

    A fragment fills a block and reaches one more to either side at most; only periods that are the
    smallest of the words they span count. Fragments of one row that overlap are joined.
    """
    done: list[tuple[int, int, int]] = []
    last: dict[int, list[int]] = {}
    for block in blocks:
        b = block - at
        forward = z_function(words[b : b + 4 * m])
        first, end = max(0, b - m), min(b + 2 * m, len(words))
        before = words[first:b][::-1]
        backward = z_function(before + array("i", [-1]) + words[first:end][::-1])
        agree = np.frombuffer(forward, np.int32)[low : 2 * m if low == m else m] >= m
        for q in (np.flatnonzero(agree) + low).tolist():
            if any(forward[d] >= q - d for d in _parts(q)):
                continue
            reach = min(forward[q], 2 * m)
            back = backward[len(before) + 1 + end - b - q]
            held = last.get(q)
            if held and held[1] >= block - back:
                held[1] = block + reach
            else:
                if held:
                    done.append((q, *held))
                last[q] = [block - back, block + reach]
    return done + [(q, *held) for q, held in last.items()]


_DOCUMENT = "_n long, _plain string, _text binary"
_TILES = "_m int, _low int, _at int, _ids array<int>, _blocks array<int>"


def _joined(text: bytes) -> str:
    """SHA-256 of the words of a text, joined by one space."""
    digest, started = sha256(), False
    for piece in word_pieces(text, _SPACE):
        part = b" ".join(piece.split())
        if part:
            digest.update(b" " + part if started else part)
            started = True
    return digest.hexdigest()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its text if it has tiles, and rows of tiles."""
    ints = pa.list_(pa.int32())
    tile_types = [pa.int32(), pa.int32(), pa.int32(), ints, ints]
    document_types = [pa.int64(), pa.string(), pa.binary()]

    def batch_of(row_type, keys, rows, documents, tiles):
        empty = [None] * len(keys)
        columns = [rows if rows is not None else pa.array(empty, row_type), pa.array(keys, pa.int64())]
        columns += [pa.array(v, t) for v, t in zip(documents or [empty] * 3, document_types, strict=True)]
        columns += [pa.array(v, t) for v, t in zip(tiles or [empty] * 5, tile_types, strict=True)]
        names = ["_row", "_key", "_n", "_plain", "_text", "_m", "_low", "_at", "_ids", "_blocks"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        row_type, keys = batch.schema.field("_row").type, batch.column("_key").to_pylist()
        held, size, documents = [], 0, ([], [], [])
        for key, text in zip(keys, text_bytes(batch.column("_text")), strict=True):
            ids, tiled = word_ids(text), False
            for tile in tile_rows(ids):
                tiled = True
                held.append((key, *tile))
                size += len(tile[3])
                if len(held) >= ROWS or size > 1 << 20:
                    own, *tiles = zip(*held, strict=True)
                    yield batch_of(row_type, own, None, None, tiles)
                    held, size = [], 0
            for column, value in zip(documents, (len(ids), _joined(text), text if tiled else None), strict=True):
                column.append(value)
        if held:
            own, *tiles = zip(*held, strict=True)
            yield batch_of(row_type, own, None, None, tiles)
        yield batch_of(row_type, keys, batch.column("_row"), documents, None)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        columns = [batch.column(n).to_pylist() for n in ("_key", "_m", "_low", "_at", "_blocks")]
        for key, m, low, at, blocks, ids in zip(*columns, batch.column("_ids"), strict=True):
            words = array("i", ids.values.to_numpy().astype(np.int32).tobytes())
            found += [(key, *fragment) for fragment in solve(m, low, at, words, blocks)]
        columns = zip(*found, strict=True) if found else [[], [], [], []]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["_key", "period", "_from", "_to"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the text without what a run repeats, and the digest of its words."""
    for batch in batches:
        texts, digests = [], []
        columns = [batch.column(n) for n in ("_text", "_plain", "runs")]
        for text, plain, runs in zip(*columns, strict=True):
            runs = runs.as_py()
            if not runs:
                texts.append(None)
                digests.append(plain.as_py())
                continue
            text = text.as_buffer().to_pybytes()
            kept = _kept(text, [(r["start"] + r["period"], r["start"] + r["length"]) for r in runs])
            texts.append(kept.decode())
            digests.append(sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string()), pa.array(digests, pa.string())],
            names=[*batch.schema.names, "collapsed", "collapsed_sha256"],
        )


def _kept(text: bytes, dropped: list[tuple[int, int]]) -> bytes:
    """The words outside of the intervals ``dropped``, joined by one space."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(dropped):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], b))
        else:
            joined.append((a, b))
    out, at, i = [], 0, 0
    for piece in word_pieces(text, _SPACE):
        words = piece.split()
        start = 0
        while start < len(words):
            while i < len(joined) and joined[i][1] <= at + start:
                i += 1
            inside = i < len(joined) and joined[i][0] <= at + start
            stop = (joined[i][1] if inside else joined[i][0]) - at if i < len(joined) else len(words)
            if not inside:
                out.append(b" ".join(words[start:stop]))
            start = min(stop, len(words))
        at += len(words)
    return b" ".join(out)


def _stitched(fragments: DataFrame) -> DataFrame:
    """``_key, start, length, period`` of the runs whose fragments these are."""
    earlier = W.partitionBy("_key", "period").orderBy("_from", "_to").rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy("_key", "period").orderBy("_from", "_to").rowsBetween(W.unboundedPreceding, 0)
    reach = fragments.withColumn("_reach", F.max("_to").over(earlier))
    opens = (F.col("_reach").isNull() | (F.col("_from") > F.col("_reach"))).cast("int")
    whole = (
        reach.withColumn("_opens", opens).withColumn("_piece", F.sum("_opens").over(until))
        .groupBy("_key", "period", "_piece")
        .agg(F.min("_from").alias("start"), F.max("_to").alias("_to"))
        .withColumn("length", F.col("_to") - F.col("start") + F.col("period"))
    )
    return whole.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_TURNS * F.col("period"))).select(
        "_key", "start", "length", "period"
    )


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its periodic runs and by what is left when they are collapsed.

    Words are separated by spaces, tabs and line ends. A run is a stretch of consecutive words of one
    smallest period, of at least 24 words and three periods, that no neighbouring word extends.
    ``n_words``; ``runs``: array of (start, length, period), by start, then period, words counted from
    0; ``collapsed``: the words that no run contains after its first period, joined by one space, null
    where no word goes; ``collapsed_sha256``: the digest of these words, or of all if none goes.

    Null, empty and blank texts have no words, and the digest of the empty text. All other columns
    pass through, those named like a made one are replaced. Every row is a document of its own, also
    among rows that repeat an id or a text. An empty table gives an empty result.

    Texts are read once and shuffled only where fingerprints agree. Any text is spread over tasks by
    its tiles; the task that reads it holds its words as numbers, the one that collapses it the text.
    """
    spark = docs.sparkSession
    made = ("n_words", "runs", "collapsed", "collapsed_sha256")
    kept = [c for c in docs.columns if c != text and c not in made]
    rows = docs.select(
        F.struct(*kept, F.lit(0).alias("_none")).alias("_row"), F.monotonically_increasing_id().alias("_key"),
        F.col(text).cast("string").alias("_text"),
    )
    inner = StructType().add("_row", rows.schema["_row"].dataType)
    inner = StructType([*inner.fields, *StructType.fromDDL(f"_key long, {_DOCUMENT}, {_TILES}").fields])
    # Written once: the keys are those of this run, and lost executors do not change them.
    parts = written(rows.mapInArrow(_exploded, inner), "period-tiles")
    tiles = parts.where("_m IS NOT NULL").select("_key", "_m", "_low", "_at", "_ids", "_blocks")
    solved = tiles.repartition(partitions(spark), "_key", "_m", "_low", "_at").mapInArrow(
        _solved, "_key long, period long, _from long, _to long"
    )
    runs = _stitched(solved).groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs")
    )
    ordered = F.transform(F.coalesce("_runs", F.array()), lambda r: F.struct(r["start"], r["length"], r["period"]))
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    documents = parts.where("_m IS NULL").select("_row", "_key", "_n", "_plain", "_text")
    whole = documents.join(runs, "_key", "left").select(
        "_row", F.col("_n").alias("n_words"), "_plain", "_text", ordered.cast(run_type).alias("runs")
    )
    out = whole.mapInArrow(
        _collapsed, StructType([*whole.schema.fields, *StructType.fromDDL("collapsed string, collapsed_sha256 string").fields])
    )
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], *made)
