"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.sources.scratch import new_path

_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_written() -> None:
    """Leave the tables that ``written`` made so far out of the next ``drop_written``."""
    _WRITTEN.clear()


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made in this process since the last call, or since ``forget_written``.

    Only for callers that know that nothing computed from them is still to be evaluated, as the
    pipeline does between two stages, whose results are written out.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def document_key(doc_id: str = "doc_id", text: str = "text"):
    """A long that stands for a document: its id, or a hash of the text where the id is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("no id"), F.col(text)))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(33))
        values = values * np.uint64(0xFF51AFD7ED558CCD)
        values = values ^ (values >> np.uint64(33))
        values = values * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(33))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal integer keys in sorted rows, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        if not columns.shape[1]:
            continue
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), columns.shape[1]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of texts, one after the other; null is empty."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def word_pieces(text: bytes, separator: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end before a separator or with the text; no word is cut."""
    at = 0
    while at < len(text):
        gap = separator.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
