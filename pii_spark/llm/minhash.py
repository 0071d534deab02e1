"""Near-duplicate documents by bottom-k sketches of their word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import document_key, mixed, partitions, runs, written
from pii_spark.llm.graph import components
from pii_spark.llm.substring import _BASE, word_hashes

#: Ids that travel to every task; more are joined by shuffle.
BROADCAST_IDS = 200_000

#: Members of an inverted list that make pairs, and documents of a larger one that are compared at a time.
BLOCK, COMPARED = 64, 256


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z is lower-cased. Fewer words than ``shingle`` are one shingle."""
    hashes = word_hashes((text or b"").lower().split())
    size = min(shingle, len(hashes))
    if not size:
        return hashes
    made = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        made = made * np.uint64(_BASE) + hashes[i : len(made) + i]
    return np.unique(mixed(made))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """``doc_id, _doc, n, print1, print2, sketch``: set size, a fingerprint of the set, its ``k`` smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, lowest = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = shingle_set(text, shingle)
                whole = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                sizes.append(len(own))
                first.append(int(whole[0]))
                second.append(int(whole[1]))
                lowest.append(own[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(lowest, pa.list_(pa.int64()))],
                names=["doc_id", "_doc", "n", "print1", "print2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), document_key().alias("_doc"), "text").mapInArrow(
        run, "doc_id long, _doc long, n int, print1 long, print2 long, sketch array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``_doc, hashes`` of the documents ``wanted`` (_doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["_doc", "hashes"])

    # A small set of ids spares the shuffle of all texts.
    side = F.broadcast(wanted) if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted
    texts = docs.select(document_key().alias("_doc"), "text").join(side, "_doc", "left_semi")
    return texts.mapInArrow(run, "_doc long, hashes binary")


def _sizes_agree(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def inverted_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """``value, _doc, n, shared, spread``: the retained values under which a document is listed.

    Documents that are similar share at least ``need`` retained values: ``percent`` of the smaller set
    where all of it is retained, and half of ``k`` otherwise (for k = 48 and 80 percent, 38.4 are expected
    with a deviation of 2.8, so a true pair has fewer with a chance of about 1e-7). So they share one of
    the ``retained - need + 1`` rarest values of either, and common values need no lists. Values of one
    document only take places in that prefix but make no list.
    """
    values = reps.select("_doc", "n", F.explode("sketch").alias("value"))
    counted = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = F.sort_array(F.collect_list(F.struct("df", "value")))
    by_doc = values.join(counted, "value").groupBy("_doc", "n").agg(own.alias("v"), F.sum("df").alias("spread"))
    retained = F.least("n", F.lit(k))
    need = F.least(F.ceil(F.col("n") * percent / 100).cast("int"), F.lit(k // 2))
    places = (retained - need + 1) - (retained - F.size("v"))
    return (
        by_doc.withColumn("_places", places).where("_places > 0")
        .select("_doc", "n", F.size("v").alias("shared"), "spread", F.explode(F.slice("v", 1, F.col("_places"))).alias("e"))
        .select(F.col("e.value").alias("value"), "_doc", "n", "shared", "spread")
    )


def centres(lists: DataFrame) -> DataFrame:
    """``value, size, centre, centre_n``: the most typical document of each list of several.

    Typical is who shares most of its retained values: among edited copies of a text, the text itself.
    """
    rank = F.struct("shared", "spread", (-F.col("_doc")).alias("_minus"), F.col("n").alias("_n"))
    return lists.groupBy("value").agg(F.count("*").alias("size"), F.max(rank).alias("_c")).where("size > 1").select(
        "value", "size", (-F.col("_c._minus")).alias("centre"), F.col("_c._n").alias("centre_n")
    )


def star_pairs(lists: DataFrame, middle: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the centre of each list with each other document of it."""
    pairs = lists.join(middle, "value").where("_doc <> centre").where(_sizes_agree(F.col("n"), F.col("centre_n"), percent))
    return pairs.select(F.least("_doc", "centre").alias("a"), F.greatest("_doc", "centre").alias("b")).distinct()


def open_lists(lists: DataFrame, middle: DataFrame, labels: DataFrame) -> DataFrame:
    """``value, size, centre, _doc, n, part``: lists whose documents are in different components so far.

    Lists that lie in one component, as those of large groups of copies mostly do by now, are done.
    """
    member = lists.join(middle.select("value", "size", "centre"), "value").join(
        labels.withColumnRenamed("id", "_doc"), "_doc", "left"
    ).select("value", "size", "centre", "_doc", "n", F.coalesce("component", "_doc").alias("part"))
    member = written(member, "list-members")
    several = member.groupBy("value").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).where("_p <> _q").select("value")
    return written(member.join(several, "value", "left_semi"), "open-lists")


def crossing_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of one list of at most ``BLOCK`` documents that are in different components."""
    listed = opened.where(F.col("size") <= BLOCK).groupBy("value").agg(F.collect_list(F.struct("_doc", "n", "part")).alias("m"))

    def partners(x: Column) -> Column:
        fit = F.filter("m", lambda y: (x["part"] != y["part"]) & (x["_doc"] < y["_doc"]) & _sizes_agree(x["n"], y["n"], percent))
        return F.transform(fit, lambda y: F.struct(x["_doc"].alias("a"), y["_doc"].alias("b")))

    return listed.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*").distinct()


def _similar(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Which sets of ``left`` are similar to which of ``right``: exact, by counts of common hashes."""
    one, other = ([np.frombuffer(x, np.uint64) for x in side] for side in (left, right))
    sizes = [np.array([len(x) for x in side]) for side in (one, other)]
    flat = [np.concatenate(side) for side in (one, other)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)
    if len(shared):
        place = [np.minimum(np.searchsorted(shared, f), len(shared) - 1) for f in flat]
        known = [shared[p] == f for p, f in zip(place, flat, strict=True)]
        for begin in range(0, len(shared), 4096):
            parts = []
            for p, k, r, n in zip(place, known, rows, sizes, strict=True):
                own = k & (p >= begin) & (p < begin + 4096)
                dense = np.zeros((len(n), min(4096, len(shared) - begin)), np.float32)
                dense[r[own], p[own] - begin] = 1
                parts.append(dense)
            common += parts[0] @ parts[1].T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def group_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: components that are linked by two documents of one list of more than ``BLOCK``.

    Lists with one centre hold mostly the same documents, so they are merged: a group is what stands in
    any list of a centre. In each group the documents outside its largest component meet all others, on
    full sets, in squares of ``COMPARED`` by ``COMPARED``. No pairs are emitted, but each two components
    that a square links, once.
    """
    member = opened.where(F.col("size") > BLOCK).select("centre", "_doc", "part").distinct()
    member = written(member, "groups")
    parts = member.groupBy("centre", "part").agg(F.count("*").alias("_n"))
    largest = parts.groupBy("centre").agg(
        F.max(F.struct("_n", "part")).alias("_l"), F.sum("_n").alias("_all")
    ).select(
        "centre", F.col("_l.part").alias("main"), F.ceil(F.col("_all") / COMPARED).cast("int").alias("columns"),
        F.ceil((F.col("_all") - F.col("_l._n")) / COMPARED).cast("int").alias("rows"),
    )
    largest = written(largest, "group-sizes")
    placed = member.join(largest, "centre")
    mine = F.xxhash64("_doc")
    every = [F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: i) for n in ("rows", "columns")]
    right = placed.where("rows > 0").select(
        "centre", "_doc", "part", F.pmod(mine, F.col("columns")).cast("int").alias("column"), F.explode(every[0]).alias("row"), F.lit(0).alias("side")
    )
    left = placed.where("rows > 0 AND part <> main").select(
        "centre", "_doc", "part", F.explode(every[1]).alias("column"), F.pmod(mine, F.col("rows")).cast("int").alias("row"), F.lit(1).alias("side")
    )
    square = ["centre", "row", "column"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, square):
            side, part = run.column("side").to_numpy(), run.column("part").to_numpy()
            hashes = run.column("hashes").to_pylist()
            i, j = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if len(i) and len(j):
                alike = _similar([hashes[x] for x in i], [hashes[x] for x in j], percent)
                a, b = np.nonzero(alike & (part[i][:, None] != part[j][None, :]))
                if len(a):
                    found = np.unique(np.stack([part[i[a]], part[j[b]]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    dealt = left.unionByName(right).join(sets, "_doc").select(*square, "side", "part", "hashes")
    n = partitions(opened.sparkSession)
    return dealt.repartition(n, *square).sortWithinPartitions(*square).mapInArrow(compare, "u long, v long")


def estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that the sketch of their union does not rule out: the ``k`` smallest values of either
    are a sample of the union, and those that both retain are its common part."""
    sketch = reps.select("_doc", "sketch")
    both = (
        pairs.join(sketch.toDF("a", "_s"), "a").join(sketch.toDF("b", "_t"), "b")
        .withColumn("_union", F.slice(F.array_sort(F.array_union("_s", "_t")), 1, k))
        .withColumn("_common", F.size(F.array_intersect(F.array_intersect("_s", "_t"), "_union")))
    )
    size = F.size("_union")
    need = F.when(size < k, F.ceil(size * percent / 100)).otherwise(F.lit(k // 2))
    return both.where(F.col("_common") >= need).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: the pairs whose full sets have a Jaccard similarity of at least ``percent`` / 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    both = pairs.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b").select("a", "b", "_x", "_y")
    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 48) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``docs`` (doc_id, text).

    Documents are linked whose sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the smallest id that links reach, and it is kept.

    1. One hash function orders the shingles; the ``k`` smallest of a set are its sketch. Documents with
       equal sets are one from here on, whatever their number.
    2. Inverted lists of the rarer retained values bring candidates together. In each list the most
       typical document is compared with all others, which makes linear work of a group of copies.
    3. The sketch of the union rules pairs out, full sets confirm the others, and components form.
    4. Only pairs of one list that are still in different components remain. All of these are compared:
       as pairs in the same way if the list is short, in squares of full sets if it is long. So no link
       between components is left out.

    Words are lower-cased in A-Z. Null texts and texts without words have an empty set and are linked with
    nothing. Rows that repeat an id are one document and should repeat the text; a null id stands for a
    document of its own text, with a null ``component_id`` if it is the smallest. An empty table gives an
    empty result.
    """
    made = written(sketches(docs, shingle, k), "sketches")
    equal = ["n", "print1", "print2"]
    reps = written(
        made.where("n > 0").groupBy(*equal).agg(F.min("_doc").alias("_doc"), F.any_value("sketch").alias("sketch")),
        "set-representatives",
    )
    lists = written(inverted_lists(reps, k, percent), "inverted-lists")
    middle = written(centres(lists), "list-centres")
    stars = written(estimated(star_pairs(lists, middle, percent), reps, k, percent), "star-pairs")
    ends = written(stars.select(F.explode(F.array("a", "b")).alias("_doc")).distinct(), "star-ends")
    sets = written(full_sets(docs, ends, shingle), "full-sets")
    links = written(linked(stars, sets, percent), "star-links")
    labels = components(links)
    opened = open_lists(lists, middle, labels)
    pairs = crossing_pairs(opened, percent).join(stars, ["a", "b"], "left_anti")
    pairs = written(estimated(pairs, reps, k, percent), "crossing-pairs")
    grouped = opened.where(F.col("size") > BLOCK).select("_doc")
    more_ends = pairs.select(F.explode(F.array("a", "b")).alias("_doc")).unionByName(grouped).distinct()
    more_ends = written(more_ends.join(ends, "_doc", "left_anti"), "crossing-ends")
    sets = sets.unionByName(written(full_sets(docs, more_ends, shingle), "full-sets"))
    crossing = linked(pairs, sets, percent)
    more = written(crossing.unionByName(group_links(opened, sets, percent)), "crossing-links")
    if not more.isEmpty():
        labels = components(labels.toDF("u", "v").unionByName(more))

    sized = made.join(reps.select(*equal, F.col("_doc").alias("_rep")), equal, "left")
    named = sized.join(labels.withColumnRenamed("id", "_rep"), "_rep", "left").select(
        "doc_id", "_doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "_rep", "_doc").alias("_c")
    )
    no_id = F.col("doc_id").isNull() & (F.col("_c") == F.col("_doc"))
    return named.select(
        "doc_id", "n_shingles", F.when(~no_id, F.col("_c")).alias("component_id"), (F.col("_c") == F.col("_doc")).alias("kept"), "_doc"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 48) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs, shingle, percent, k).where("NOT kept").select("_doc").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"), document_key().alias("_doc"))
    return whole.join(gone, "_doc", "left_anti").select("_row.*")
