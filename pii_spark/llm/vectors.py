"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import partitions, runs, written
from pii_spark.llm.graph import components

#: Projections whose window collisions are counted, and their seed.
PROJECTIONS, SEED = 32, 20_240_601

#: Vectors that a cell should hold, and the most that are compared in one step.
CELL, BLOCK = 256, 1024


class Plan:
    """Cells, windows and counts for a threshold and a number of vectors.

    A projection on a Gaussian direction differs between unit vectors by a normal variable whose
    deviation is their distance. So the chance that a pair at the threshold falls into one window, or on
    one side of a cut, is known, and all parameters follow from the recall that is asked for.
    """

    def __init__(self, threshold: float, n: int, recall: float = 0.999):
        self.threshold = threshold
        angle = math.acos(threshold)
        distance = math.sqrt(2 - 2 * threshold)
        self.distance = distance
        self.window = 1.8 * distance
        collide = math.erf(self.window / distance / math.sqrt(2))
        self.bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
        same_cell = (1 - angle / math.pi) ** self.bits
        missed = (1 - recall) / 2
        self.tables = 1 if same_cell == 1 else math.ceil(math.log(missed) / math.log(1 - same_cell))
        self.least = PROJECTIONS
        while self.least and self._below(self.least, collide) > missed:
            self.least -= 1

    @staticmethod
    def _below(count: int, p: float) -> float:
        """Chance of fewer than ``count`` collisions among all projections."""
        return sum(math.comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(count))


@cache
def directions(dimension: int, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions: those that are counted, and those that cut each table's cells."""
    rng = np.random.default_rng([SEED, dimension])
    return rng.normal(size=(dimension, PROJECTIONS)), rng.normal(size=(dimension, tables * bits))


def unit(block: np.ndarray) -> np.ndarray:
    block = block.astype(np.float64)
    # The largest component first, so that no square overflows or vanishes.
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def cell_codes(units: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of each vector in each table: the sides of its cuts as bits."""
    _, cuts = directions(units.shape[1], plan.tables, plan.bits)
    sides = (units @ cuts > 0).reshape(len(units), plan.tables, plan.bits)
    return sides @ (1 << np.arange(plan.bits, dtype=np.int64)) if plan.bits else np.zeros((len(units), plan.tables), np.int64)


def links_between(units: np.ndarray, second: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at or over the threshold: of all rows, or where ``second`` is mixed, across its values.

    The rows are sorted by the first projection. A run of queries meets all rows that can be at the
    threshold there: no projection differs by more than the distance times the length of its direction,
    so none is lost. Collisions are counted over all projections, and pairs with enough are verified.
    """
    counted, _ = directions(units.shape[1], plan.tables, plan.bits)
    # A little more, for the rounding of the places.
    reach = plan.distance * float(np.linalg.norm(counted[:, 0])) + 1e-3
    places = units @ counted
    order = np.argsort(places[:, 0], kind="stable")
    places, units, second = places[order].astype(np.float32), units[order], second[order]
    crossing = bool(second.any()) and not bool(second.all())
    first, found_i, found_j = places[:, 0], [], []
    for begin in range(0, len(units), 128):
        end = min(begin + 128, len(units))
        stop = int(np.searchsorted(first, first[end - 1] + reach, side="right"))
        count = np.zeros((end - begin, stop - begin), np.uint8)
        for p in range(PROJECTIONS):
            count += np.abs(places[begin:end, p, None] - places[None, begin:stop, p]) <= np.float32(plan.window)
        i, j = np.nonzero(count >= plan.least)
        i, j = i + begin, j + begin
        keep = (i < j) & (second[i] != second[j]) if crossing else i < j
        i, j = i[keep], j[keep]
        for part in range(0, len(i), 65_536):
            a, b = i[part : part + 65_536], j[part : part + 65_536]
            close = np.einsum("ij,ij->i", units[a], units[b]) >= plan.threshold
            found_i.append(order[a[close]])
            found_j.append(order[b[close]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _smallest_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        if (after == label).all():
            return label
        label = after


def _compare(table: int, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, second: np.ndarray, plan: Plan):
    """``rep, links, root`` of the rows of one cell or pair of blocks that have links there.

    A pair counts in the first table only in which it shares a cell, so it counts once.
    """
    units = unit(vectors)
    i, j = links_between(units, second, plan)
    if not len(i):
        return None
    codes = cell_codes(units, plan)
    fresh = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i[fresh], copies[j[fresh]])
    np.add.at(links, j[fresh], copies[i[fresh]])
    root = _smallest_reached(ids, i, j)
    some = np.zeros(len(ids), bool)
    some[i] = some[j] = True
    return ids[some], links[some], root[some]


_CELL_KEYS = ["size", "table", "cell", "low", "high"]


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, key: str = "vec_id",
                 value: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` of ``vectors`` (key, value: array of floats or doubles).

    Vectors of one length are linked whose cosine, in double precision, is at least ``threshold``.
    ``n_links`` counts the other rows that a row is linked with directly, ``component_id`` is the
    smallest key that links reach, and that row is kept.

    A window on one projection that keeps pairs at the threshold holds a large part of all vectors, so
    windows alone would compare nearly all pairs. Cells come first: in each of several tables, cuts of
    independent projections put vectors into cells of about ``CELL``, and so many tables are made that a
    pair at the threshold shares a cell somewhere with the chance ``recall`` asks for. Inside a cell the
    vectors are sorted by a projection; each is the centre of a window on every one of ``PROJECTIONS``
    projections, collisions are counted per pair, and the pairs that pass the count calibrated for the
    recall are verified exactly. Nearer pairs have better chances; no pair below the threshold is linked.

    Equal vectors are one from the start, whatever their number. Cells of more than ``BLOCK`` vectors are
    dealt into blocks, and blocks meet blocks, each in a task of its own. Pairs are not emitted: a
    comparison gives one row per vector, with its links and the smallest key that they reach.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows that
    repeat a key count as rows. A null key stands for a row of its own vector and gives a null
    ``component_id`` where it would be the smallest. An empty table gives an empty result.
    """
    vector = F.col(value)
    wide = dict(vectors.dtypes)[value] == "array<double>"
    kind = np.float64 if wide else np.float32
    rows = vectors.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(F.col(key).cast("long"), F.xxhash64(F.lit("no id"), vector)).alias("_id"),
        vector.cast("array<double>" if wide else "array<float>").alias("_v"),
    )
    print_ = [F.xxhash64("_v").alias("_h1"), F.xxhash64(F.lit(1), F.col("_v")).alias("_h2")]
    rows = written(rows.select("_key", "_id", _valid(F.col("_v")).alias("_ok"), "_v", *print_), "vectors")
    reps = written(
        rows.where("_ok").groupBy("_h1", "_h2")
        .agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.any_value("_v").alias("_v")),
        "distinct-vectors",
    )
    plan = Plan(threshold, reps.count(), recall)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(own))
                block = part.column("_v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(own), size)
                codes = cell_codes(unit(block), plan)
                packed = pa.array([row.tobytes() for row in block], pa.binary())
                for table in range(plan.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), size), pa.int32()), pa.array(np.full(len(own), table), pa.int32()),
                         pa.array(codes[:, table]), part.column("rep"), part.column("copies"), packed],
                        names=["size", "table", "cell", "rep", "copies", "vector"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _CELL_KEYS):
            size, table = group.column("size")[0].as_py(), group.column("table")[0].as_py()
            block = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(-1, size)
            ids, copies, second = (group.column(c).to_numpy() for c in ("rep", "copies", "second"))
            made = _compare(table, ids, copies, block, second, plan)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["rep", "links", "root"])

    celled = reps.select("rep", "copies", "_v").mapInArrow(
        cells, "size int, table int, cell long, rep long, copies long, vector binary"
    )
    cell = ["size", "table", "cell"]
    filled = written(celled.groupBy(*cell).agg(F.count("*").alias("_n")).where("_n > 1"), "cells")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    # A row meets every block of its cell once; the lower block number comes first.
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(
        F.least(b, F.col("_mine")).alias("low"), F.greatest(b, F.col("_mine")).alias("high"),
        (F.col("_mine") > b).alias("second")))
    dealt = (
        celled.join(filled, cell).withColumn("_blocks", blocks).withColumn("_mine", mine)
        .withColumn("_pair", F.explode(pairs))
        .select(*cell, "_pair.*", "rep", "copies", "vector")
    )
    n = partitions(vectors.sparkSession)
    compared = written(
        dealt.repartition(n, *_CELL_KEYS).sortWithinPartitions(*_CELL_KEYS).mapInArrow(compare, "rep long, links long, root long"),
        "vector-links",
    )
    counts = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(compared.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = reps.select("_h1", "_h2", "rep", "copies").join(counts, "rep", "left").join(
        labels.withColumnRenamed("id", "rep"), "rep", "left"
    )
    out = rows.where("_ok").select("_key", "_id", "_h1", "_h2").join(classes, ["_h1", "_h2"]).select(
        "_key", "_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("_c"),
    ).unionByName(rows.where("NOT _ok").select("_key", "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("_c")))
    no_key = F.col("_key").isNull() & (F.col("_c") == F.col("_id"))
    return out.select(
        F.col("_key").alias(key), "n_links", F.when(~no_key, F.col("_c")).alias("component_id"),
        (F.col("_c") == F.col("_id")).alias("kept"),
    )
