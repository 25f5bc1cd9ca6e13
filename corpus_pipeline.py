"""The training-data pipeline: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, language, secrets, segmentation, simhash
from quern.sources.tables import table, written

#: Bits a symbol above which no learned language fits a text (phrases of under 2.7 symbols), if it has so many symbols.
REJECT_BITS, LEAST_SYMBOLS = 6.0, 40
#: In a script of many letters, where a letter by itself takes more bits than REJECT_BITS less this, so many bits above those are allowed.
OVER_LETTERS = 1.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that one of the languages fits. Each row is judged by its own text; null and empty ones go."""
    return language.fitting(docs, REJECT_BITS, OVER_LETTERS, LEAST_SYMBOLS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Equal rows stay or go together."""
    return simhash.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Each row is judged by its own text, those with a null doc_id too."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; a null text stays null."""
    return secrets.masked(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, the text they decode to, and whether that is the document's; a null text is empty."""
    return segmentation.encode(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("segmentation", encoded),
]

#: SimHash components, cross-parsing and sampled segmentations can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
