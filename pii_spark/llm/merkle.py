"""Merkle manifest of a table: one tree per group of rows, one tree over the groups, a proof for every row.

Nodes are labelled (tree, level, place), children before parents, and swept in that order: a node
takes the digests of its children from a priority queue and sends its own to its parent. A second
sweep in reversed order sends every node what proves it, from the root down to the leaves. The queue
between blocks of nodes is external: a written table that a shuffle orders by the label of the block
that receives it. Inside a block, which is bounded, it is a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pii_spark.llm.common import partitions, written

#: Children of a node, levels that one block spans, and the nodes of its lowest level.
ARITY, HEIGHT = 16, 3
BLOCK = ARITY**HEIGHT

#: Columns that ``manifest`` adds.
MADE = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

_MESSAGE = ("_subroot", "_root", "_above")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields of a row, one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def swept_up(digests: list[str], levels: int) -> list[list[str]]:
    """All nodes of a block, level by level: ``digests`` first, then ``levels`` more."""
    nodes: list[list[str]] = [digests, *([] for _ in range(levels))]
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        level, place = queue[0][:2]
        inbox = []
        while queue and queue[0][:2] == (level, place):
            inbox.append(heapq.heappop(queue)[3])
        digest = joined(inbox)
        nodes[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // ARITY, place, digest))
    return nodes


def swept_down(nodes: list[list[str]], above: tuple) -> Iterator[tuple]:
    """For each node of the lowest level, in order, the siblings (left, right) on its way to the root.

    ``above`` is the way from the block's root on. The ways share their upper parts.
    """
    queue = [(1 - len(nodes), 0, above)]
    while queue:
        level, place, way = heapq.heappop(queue)
        if level == 0:
            yield way
            continue
        children = nodes[-level - 1][place * ARITY : (place + 1) * ARITY]
        run, at = "".join(children), 0
        for i, child in enumerate(children):
            sides = (run[:at], run[at + len(child) :])
            heapq.heappush(queue, (level + 1, place * ARITY + i, (sides, *way)))
            at += len(child)


def folded(digest: str, way: tuple) -> str:
    """The root that ``digest`` and the siblings on its way give."""
    for left, right in way:
        digest = joined([left, digest, right])
    return digest


def _levels(total: int) -> int:
    """Levels that a block of a tree with ``total`` nodes at its lowest level spans."""
    levels = 0
    while total > 1 and levels < HEIGHT:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def _block(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    table = table.sort_by("_place")
    return table, swept_up(table["_digest"].to_pylist(), _levels(table["_total"][0].as_py()))


def _send_up(table: pa.Table) -> pa.Table:
    table, nodes = _block(table)
    total = table["_total"][0].as_py()
    for _ in range(len(nodes) - 1):
        total = -(-total // ARITY)
    block = table["_place"][0].as_py() // BLOCK
    return pa.table({"_tree": table["_tree"][:1], "_place": [block], "_digest": nodes[-1], "_total": [total]})


def _ways(table: pa.Table, message: pa.Table) -> tuple[pa.Table, Iterator[tuple]]:
    table, nodes = _block(table)
    above = tuple((s["left"], s["right"]) for s in message["_above"][0].as_py())
    return table, swept_down(nodes, above)


def _same(value: pa.ChunkedArray, n: int) -> pa.Array:
    return pa.array([value[0].as_py()] * n, pa.string())


def _send_down(table: pa.Table, message: pa.Table) -> pa.Table:
    table, ways = _ways(table, message)
    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    above = pa.array([[{"left": a, "right": b} for a, b in way] for way in ways], sides)
    for name in ("_subroot", "_root"):
        table = table.append_column(name, _same(message[name], len(table)))
    return table.append_column("_above", above)


def _prove(table: pa.Table, message: pa.Table) -> pa.Table:
    table, ways = _ways(table, message)
    proofs, roots = [], []
    for way, leaf, offered in zip(ways, table["_digest"].to_pylist(), table["_offered"].to_pylist(), strict=True):
        proofs.append(joined([side for sides in way for side in sides]))
        roots.append(folded(offered or leaf, way))
    n = len(table)
    return pa.table({
        "_row": table["_row"], "leaf": table["_digest"], "subroot": _same(message["_subroot"], n),
        "root": _same(message["_root"], n), "proof_sha256": proofs, "folded_root": roots,
    })


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_place`` (from 0, by ``order`` inside a ``_tree``) and ``_total`` (rows of the tree).

    Rows are dealt to ranges of (tree, order), so one large tree spreads over many tasks; the counts
    of the ranges, a row for each range and tree, give the places of their first rows.
    """
    rows = written(rows, "merkle-rows")
    ranged = written(
        rows.repartitionByRange(partitions(rows.sparkSession), "_tree", *order)
        .withColumn("_range", F.spark_partition_id()),
        "merkle-ranges",
    )
    counts = ranged.groupBy("_range", "_tree").agg(F.count("*").alias("_n"))
    # At most a row per range in a window.
    tree = W.partitionBy("_tree")
    ahead = tree.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_range", "_tree", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"),
        F.sum("_n").over(tree).alias("_total"),
    )
    inside = W.partitionBy("_range", "_tree").orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["_range", "_tree"])
    return placed.withColumn("_place", F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")


def _block_key() -> Column:
    return F.expr(f"_place div {BLOCK}").alias("_block")


def _type(base: StructType, *names: str) -> StructType:
    """``base`` with further fields; texts but ``_above``."""
    sides = StructType().add("left", "string").add("right", "string")
    out = StructType(list(base.fields))
    for name in names:
        out = out.add(name, ArrayType(sides) if name == "_above" else "string")
    return out


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds of the upward sweep, and ``_tree, _digest, _round`` of the roots.

    A round lifts every tree by up to ``HEIGHT`` levels; each block of it is one bounded group.
    """
    schema = "_tree string, _place long, _digest string, _total long"
    rounds = [written(leaves, "merkle-nodes")]
    while rounds[-1].where("_total > 1").limit(1).count():
        groups = rounds[-1].where("_total > 1").select("_tree", "_place", "_digest", "_total")
        rounds.append(written(groups.groupBy("_tree", _block_key()).applyInArrow(_send_up, schema), "merkle-nodes"))
    roots = [
        r.where("_total = 1").select("_tree", "_digest", F.lit(i).alias("_round")) for i, r in enumerate(rounds)
    ]
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return rounds, found


def _descend(rounds: list[DataFrame], tops: DataFrame, last, schema: StructType) -> DataFrame:
    """The downward sweep: ``tops`` are the messages to the roots, ``last`` handles the leaves."""
    messages = None
    # The last round holds roots only, if there is another.
    for i, nodes in reversed(list(enumerate(rounds[:-1] or rounds))):
        # The root of a tree stands in the round after the blocks below it; a lone leaf is its own root.
        inbox = tops.where(F.col("_round") == i + 1 if i else F.col("_round") <= 1)
        inbox = inbox.select("_tree", F.lit(0).cast("long").alias("_block"), "_subroot", "_root", "_above")
        if messages is not None:
            inbox = inbox.unionByName(messages)
        sent = nodes.where("_total > 1") if i else nodes
        pairs = sent.groupBy("_tree", _block_key()).cogroup(inbox.groupBy("_tree", "_block"))
        if i == 0:
            return pairs.applyInArrow(last, schema)
        passed = written(pairs.applyInArrow(_send_down, _type(nodes.schema, *_MESSAGE)), "merkle-messages")
        messages = passed.select("_tree", F.col("_place").alias("_block"), *_MESSAGE)
    raise AssertionError("there is always a round of leaves")


def manifest(
    leaves: DataFrame, tree: str = "source", order: str = "doc_id", leaf: str = "leaf", offered: str = "offered"
) -> DataFrame:
    """Add ``leaf, subroot, root, proof_sha256, folded_root, verified`` to rows with digests.

    ``leaf`` holds the digest of a row. The leaves of each value of ``tree`` ascend by ``order``
    (null first, ties by digest); while more than one node is left, every 16 consecutive ones (the
    last run: fewer, even one) become the digest of their hex digests, which gives ``subroot``. The
    subroots, ordered by ``tree`` (null first, then bytewise), give ``root`` by the same law.
    ``proof_sha256`` is the digest of the siblings on the way up, left to right, level by level;
    ``folded_root`` is the root that these and ``offered`` (null: the leaf) give; ``verified`` tells
    whether it equals the root. A lone leaf is its tree's root and a lone tree's root is the root.

    Other columns pass through, those named like a made one are replaced, and ``offered`` goes. Equal
    rows are interchangeable. An empty table gives an empty result. The rows should hold no long
    texts, since they are shuffled. Only counts come to the driver; no group exceeds 4096 nodes.
    """
    kept = [c for c in leaves.columns if c not in MADE and c != offered]
    name = F.col(tree).cast("string")
    rows = leaves.select(
        F.struct(*kept).alias("_row"),
        F.when(name.isNull(), "0").otherwise(F.concat(F.lit("1"), name)).alias("_tree"),
        F.col(order).alias("_order"), F.col(leaf).alias("_digest"), F.col(offered).alias("_offered"),
    )
    rounds, subroots = _climb(_numbered(rows, ["_order", "_digest"]).drop("_order"))
    top = subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_digest", F.col("_round").alias("_found"))
    top_rounds, root = _climb(_numbered(top, ["_name"]))
    none = F.array().cast(_type(StructType(), "_above")["_above"].dataType).alias("_above")
    tops = root.select("_tree", F.lit("").alias("_subroot"), F.col("_digest").alias("_root"), none, "_round")
    ends = _descend(top_rounds, tops, _send_down, _type(top_rounds[0].schema, *_MESSAGE))
    ends = written(ends, "merkle-messages").select(
        F.col("_name").alias("_tree"), F.col("_digest").alias("_subroot"), "_root", "_above", F.col("_found").alias("_round")
    )
    proven = _descend(rounds, ends, _prove, _type(StructType([rounds[0].schema["_row"]]), *MADE[:-1]))
    return proven.select(
        *[F.col("_row").getField(c).alias(c) for c in kept], *MADE[:-1],
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, offered`` of documents.

    ``offered`` is the digest of a tampered row: where 5 divides the CRC-32 of the decimal ``doc_id``,
    the letters A to Z of the text are lower-cased. It is null for all others and for null ids.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = row_digest(*fields, F.translate("text", upper, upper.lower()))
    return docs.select(
        "doc_id", "source", row_digest(*fields, F.col("text")).alias("leaf"), F.when(chosen, tampered).alias("offered")
    )
