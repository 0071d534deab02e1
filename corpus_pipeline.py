"""From raw documents to packed sequences: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.llm import language, lines, minhash, packing, substring
from pii_spark.llm.common import drop_written, forget_written, table
from pii_spark.llm.queries import tokenizer_path
from pii_spark.sources.scratch import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Lowest mean probability of the language of a document that is kept.
MIN_SCORE = 0.4

#: Words of the shortest passage that is cut where it repeats.
PASSAGE = 50


def _documents(docs: DataFrame, text: bool = False) -> DataFrame:
    """The columns of documents; ``n_chars`` follows a changed text."""
    if text:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the model tells; texts that are null, have no letters or score low go."""
    forget_written()
    model = language.train(language.training_lines(docs, ~language.held_out(F.col("doc_id"))))
    return _documents(language.identify(docs, model, MIN_SCORE))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that stand on many sources; no document goes."""
    drop_written(spark)
    return _documents(lines.remove_spread_lines(docs), text=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8)."""
    drop_written(spark)
    return _documents(minhash.drop_near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of at least ``PASSAGE`` words that occur again; documents of which nothing is left go."""
    drop_written(spark)
    cut = substring.remove_repeats(docs, length=PASSAGE)
    return _documents(cut.where("n_removed = 0 OR n_removed < n_words"), text=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    drop_written(spark)
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify_language),
    ("line dedup", remove_boilerplate),
    ("near-duplicate removal", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: The language model and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents of ``sf_dir`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
