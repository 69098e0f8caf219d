"""A corpus from raw documents to packed sequences, one written table per stage.

Each stage takes what the one before it kept; all but the last return the columns of
documents. STAGES names them in order; run() applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import exact, langid, mixing, packing, simhash
from cadenza.llm.registry import tokenizer_path
from cadenza.sources.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label each document with its language; those without any letter go.

    The language column of the result is the predicted one. A null or empty text has no letter
    and goes. A null id isn't held out from learning; repeated rows are learned once and stay
    each. Ties between languages go to the first by code point. Without labelled texts nothing is
    identified and all rows go; an empty table gives none. Other columns stay as they are.
    """
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the smallest id stays.

    A null text equals an empty one; null ids come last; of rows that repeat both id and text one
    stays. An empty table gives no rows. Other columns stay as they are.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints the document with the smallest id stays.

    Texts without words (null ones too) share the fingerprint zero and are linked like others.
    Null ids come last; of rows that repeat id and fingerprint one stays. An empty table gives no
    rows. Other columns stay as they are.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the source mix: a row for each pass that reaches a document's first word.

    A null source is a source, last in order; null texts have no words and go. Null ids are
    shuffled as the empty text; repeated rows are documents of their own. An empty table gives no
    rows. Other columns stay as they are.
    """
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences.

    A null text is a document of the end id only; null ids are ids like any other; repeated rows
    are packed each, and equal pieces take each other's places. An empty table gives no rows.
    """
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact),
    ("near", drop_near),
    ("mix", mix),
    ("pack", pack),
]

#: Language scores and token ids can't be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
