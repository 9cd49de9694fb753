"""Corpus preparation: language, lines, near-duplicates, mix, packing.

Each stage's result is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid
from tidemark.llm.line_dedup import without_shared_lines
from tidemark.llm.mixing import mixed
from tidemark.llm.near_copies import one_of_near
from tidemark.llm.packing import pack
from tidemark.llm.shared import written
from tidemark.llm.simhash import one_of_each


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models learn from a bounded sample of labelled rows.

    Null texts and texts without letters go, as no language is recognised in them. Repeated rows
    are judged alike; where no row has a language all texts with letters stay.
    """
    return langid.predict(docs, langid.fit(docs), accepted_only=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share. A null text stays null."""
    return without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by op8's parameters; not a stage.

    Null, empty and blank texts are one group; of repeated rows one stays.
    """
    return one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more.

    Null, empty and blank texts are one group; of repeated rows one stays.
    """
    return one_of_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken twice is there twice.

    Documents without words are in no mix; a null source is a source; repeated rows count each.
    """
    return mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null text counts as empty and has its end token. Repeated rows are
    documents of their own, and an empty table gives no pieces."""
    return pack(docs)


STAGES = [("language_id", languages), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("mixing", mix), ("packing", sequences)]

#: Language models, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
