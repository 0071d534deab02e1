"""Conversations whose messages quote each other: quotes are linked to their originals and taken out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import written

#: Markers of quoted lines: one for each level.
MARKERS = r"^(?: {0,3}> ?)+"

#: What separates the words of a passage when passages are compared.
BETWEEN = r"[^\p{L}\p{N}]+"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    def line(raw: Column) -> Column:
        body = F.regexp_replace(raw, MARKERS, "")
        markers = F.regexp_replace(F.regexp_extract(raw, MARKERS, 0), "[^>]", "")
        plain = F.trim(F.regexp_replace(F.lower(body), BETWEEN, " "))
        return F.struct(F.length(markers).alias("level"), body.alias("body"), plain.alias("plain"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), line)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, parted by lines without words: level and lines, in order."""

    def at(i: Column, name: str) -> Column:
        return F.get(lines, i).getField(name)

    def parted(i: Column, j: Column) -> Column:
        return F.coalesce((at(j, "plain") == "") | (at(j, "level") != at(i, "level")), F.lit(True))

    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: at(i, "plain") != "")
    starts = F.filter(places, lambda i: parted(i, i - 1))
    ends = F.filter(places, lambda i: parted(i, i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(
        at(s, "level").alias("level"), F.transform(F.slice(lines, s + 1, e - s + 1), lambda x: x["plain"]).alias("lines")))


def _hashes(plain: Column) -> list[Column]:
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2")]


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` as ``_row``, with ``body`` (the text without quoted lines) and ``passages``."""
    lines = _lines(F.col("text"))

    def read(x: Column) -> Column:
        own = F.transform(F.filter(x, lambda line: line["level"] == 0), lambda line: line["body"])
        text = F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")
        return F.struct(text.alias("body"), _passages(x).alias("passages"))

    whole = messages.select(F.struct(*messages.columns).alias("_row"), _bound(lines, read).alias("_m"))
    return whole.select(
        "_row", F.col("_row.conv_id").alias("conv_id"), F.col("_row.turn").alias("turn"),
        F.when(F.col("_row.text").isNotNull(), F.col("_m.body")).alias("body"), F.col("_m.passages").alias("passages"),
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, n_linked, reply_to`` of the messages of ``parsed`` that quote an earlier one."""
    passage = messages.select("conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    # A passage can be found as a whole or by its lines.
    pieces = F.concat(
        F.array(F.struct(F.lit(0).alias("part"), F.array_join("p.lines", " ").alias("plain"))),
        F.when(F.size("p.lines") > 1, F.transform("p.lines", lambda x: F.struct(F.lit(1).alias("part"), x.alias("plain"))))
        .otherwise(F.array().cast("array<struct<part:int,plain:string>>")),
    )
    pieces = passage.select("conv_id", "turn", "place", F.col("p.level").alias("level"), F.explode(pieces).alias("x")).select(
        "conv_id", "turn", "place", "level", F.col("x.part").alias("part"), *_hashes(F.col("x.plain"))
    )
    pieces = written(pieces, "passages")
    key = ["conv_id", "h1", "h2"]
    # One row per passage of a conversation, however often it is repeated there.
    originals = pieces.where("level = 0").groupBy(*key).agg(F.min("turn").alias("origin"))
    found = pieces.where("level > 0").join(originals, key).where("origin < turn")
    best = F.min(F.struct("level", "part", (-F.col("origin")).alias("o")))
    return found.groupBy("conv_id", "turn").agg(
        F.size(F.collect_set("place")).alias("n_linked"), (-best["o"]).alias("reply_to")
    )


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth``: the message that replies lead back to, and over how many steps.

    Every round doubles the steps looked back, so a chain of n replies takes log2(n) rounds, and only
    messages that have not come to the first one yet take part in the next.
    """
    columns = ["conv_id", "turn", "up", "depth"]
    first = links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    active, settled = written(first, "replies"), first.limit(0)
    while True:
        known = active.select(columns).unionByName(settled)
        above = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = written(active.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("_up", "up").alias("up"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_moved"),
        ), "replies")
        settled = settled.unionByName(moved.where("NOT _moved").select(columns))
        active = moved.where("_moved")
        if active.isEmpty():
            return settled.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


#: Columns that ``link_quotes`` returns anew.
MADE = ("body", "formatted", "n_quotes", "n_linked", "reply_to", "thread", "depth")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) without quotes and with their place in the conversation.

    Adds ``body`` (the lines that are no quotes, without blank lines around), ``formatted`` (role and
    body), ``n_quotes`` and ``n_linked`` (quoted passages, and those whose original was found),
    ``reply_to`` (turn), ``thread`` (turn that replies lead back to) and ``depth``.

    Quoted lines start with ``>``, once for each level. A passage is a run of lines of one level without
    blank lines; passages are compared by words, in lower case, without marks. Its original is the first
    earlier turn of the conversation that has the passage, or one of its lines, unquoted. A message replies
    to the original of its lowest level of quotes, whole passages before lines, then the latest turn.
    Sorting by ``conv_id, thread, turn`` puts every message after the one that it replies to.

    The result has rows, not a list per conversation, since a conversation can hold any number of messages.
    Null texts have no passages and a null body; messages of a null conv_id or turn are linked with nothing,
    and so is a quote of the own or a later turn. Rows that repeat conv_id and turn are one message of
    several texts. An empty table gives an empty result. Extra columns pass through.
    """
    read = parsed(messages)
    links = written(quote_links(read), "quote-links")
    placed = links.join(threads(links), ["conv_id", "turn"])
    joined = read.join(placed, ["conv_id", "turn"], "left")
    made = joined.select("_row", F.struct(
        "body",
        F.concat(F.lit("<|"), F.coalesce("_row.role", F.lit("")), F.lit("|>\n"), F.coalesce("body", F.lit(""))).alias("formatted"),
        F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    ).alias("_made"))
    return made.select(*[f"_row.`{c}`" for c in messages.columns if c not in MADE], "_made.*")


def reply_ordered(linked: DataFrame, n: int) -> DataFrame:
    """The rows of ``link_quotes`` in ``n`` sorted ranges, as they are written for training."""
    order = ["conv_id", "thread", "turn"]
    return linked.repartitionByRange(n, *order).sortWithinPartitions(*order)
