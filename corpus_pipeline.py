"""The corpus pipeline: toxic documents go, one of each group of near-copies stays, secrets are masked, sources are
mixed to target weights, and the mix is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import jaccard_join, mixing, packing, secrets, toxicity
from gristmill.llm.common import written
from gristmill.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't predict toxic; it learns from the labelled ones of ``docs`` that aren't held out.
    A null or empty text has no toxic words and stays; repeated rows are judged each."""
    return toxicity.reject(docs, toxicity.fit_tables(spark, sf_dir, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links, of the least doc_id (nulls last) and of rows that share it one by text, so that
    an id with two texts loses neither to the other. Rows without words (null, empty, white space) all stay."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every secret's span replaced by a mark; null and empty texts stay as they are, repeated rows all stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document whole, as often as the mix takes it. Those that it doesn't take go, as do texts without words, which
    have no size. Rows alike count each; columns with the mix's own names keep their values."""
    aside = {c: f"_kept_{c}" for c in docs.columns if c in mixing.ADDED}
    mixed = mixing.mixed_whole(docs.withColumnsRenamed(aside))
    return mixed.withColumnsRenamed({new: c for c, new in aside.items()}).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences and places; a null or empty text is the closing id alone."""
    return packing.pack(packing.pieces(docs, vocabulary_path(packing.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages have no SQL of their own but the mix; ``tests/llm`` holds each, and ``run``, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input. Empty tables give empty results."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
