"""The same operators on Structured Streaming tables.

Detection and masking are row-local expressions, so they need no streaming form of their own. What
is left here are joins, windows and the vault, which keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pii_spark.functions.spans import restore_text
from pii_spark.operators.detect import RULES, detect_rules
from pii_spark.operators.mask import mask_text
from pii_spark.sources.vault_store import BUCKETS, delete_from_store, expire_store, read_store, upsert_store


def mask_stream(requests: DataFrame, text: str = "text", rules=RULES, salt: str = "") -> DataFrame:
    return mask_text(detect_rules(requests, rules, text), text, salt=salt)


def join_answers(
    requests: DataFrame, answers: DataFrame, bound: str = "30 seconds", lateness: str = "1 minute"
) -> DataFrame:
    """Requests with their answer within ``bound``, or with none.

    Needs ``transaction_id, ts, masked_to_original`` and ``transaction_id, ts, answer``. The bound
    and both watermarks let the state of old requests go.
    """
    r = requests.withWatermark("ts", lateness).select(
        F.col("transaction_id"), F.col("ts").alias("asked"), "masked_to_original"
    )
    a = answers.withWatermark("ts", lateness).select(
        F.col("transaction_id").alias("answer_id"), F.col("ts").alias("answered"), "answer"
    )
    match = (
        (F.col("transaction_id") == F.col("answer_id"))
        & (F.col("answered") >= F.col("asked"))
        & (F.col("answered") <= F.col("asked") + F.expr(f"interval {bound}"))
    )
    return r.join(a, match, "leftOuter")


def restore_stream(requests: DataFrame, answers: DataFrame, bound: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """Restored answers by transaction; null where no answer came in time."""
    return join_answers(requests, answers, bound, lateness).select(
        "transaction_id", "asked", "answered",
        F.when(F.col("answer").isNotNull(), restore_text(F.col("answer"), F.col("masked_to_original"))).alias("restored"),
    )


def unanswered_requests(requests: DataFrame, answers: DataFrame, bound: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    return join_answers(requests, answers, bound, lateness).where(F.col("answer_id").isNull()).select(
        "transaction_id", "asked"
    )


def pii_rate_windows(
    hits: DataFrame, by: str = "label", ts: str = "ts", length: str = "10 minutes",
    slide: str | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Rows per ``by`` and window. Counts are combined before the shuffle, so a hot label is cheap."""
    windowed = hits.withWatermark(ts, lateness).groupBy(F.window(ts, length, slide), by)
    return windowed.agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n"
    )


def vault_stream(
    spark: SparkSession, hits: DataFrame, path: str, checkpoint: str, lateness: str | None = None,
    max_age: str | None = None, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Keep a vault store up to date from a stream of hits: one version per micro-batch with hits.

    A micro-batch is grouped once and rewrites the buckets of its originals only. The store knows the
    last batch it took up, so a repeated one does nothing. With ``lateness``, hits repeated under the
    same ``hit_id`` count once. With ``max_age``, rows created that long before the batch's latest hit
    expire; see ``idle_keys`` for keys that are not used any more.
    """
    if lateness is not None:
        hits = hits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["hit_id"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_store(spark, path, batch, buckets, batch_id)
        if max_age is not None:
            # One value; an empty batch has no time of its own and expires nothing.
            now = batch.agg(F.max("ts")).first()[0]
            if now is not None:
                expire_store(spark, path, F.lit(now), max_age)

    return (
        hits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )


def idle_keys(hits: DataFrame, idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Originals that were not hit for ``idle``: one row for each stretch of use that ended so.

    A stretch is a session of hits; it ends when the watermark has passed its last hit by ``idle``,
    and its state goes. Unlike expiry by creation time, every hit keeps a key alive. Gives
    (original_pii, created_at, last_accessed_at, access_count, idle_at).
    """
    sessions = hits.withWatermark("ts", lateness).groupBy(F.session_window("ts", idle), "original_pii")
    return sessions.agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed_at"), F.count("*").alias("access_count")
    ).select(
        "original_pii", "created_at", "last_accessed_at", "access_count", F.col("session_window.end").alias("idle_at")
    )


def vault_idle_stream(
    spark: SparkSession, hits: DataFrame, path: str, checkpoint: str, idle: str = "1 hour", lateness: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Remove keys from a vault store once they are idle.

    A key that the store knows as used after its idle stretch stays, so the order in which this stream
    and ``vault_stream`` see the hits does not matter, and a repeated micro-batch finds nothing to do.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        gone = batch.groupBy("original_pii").agg(F.max("last_accessed_at").alias("idle_since"))
        unused = read_store(spark, path).join(gone, "original_pii").where("last_accessed_at <= idle_since")
        delete_from_store(spark, path, unused.select("original_pii"))

    return (
        idle_keys(hits, idle, lateness).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
