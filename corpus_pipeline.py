"""A corpus from raw documents to packed sequences, one operator after the other.

Each stage takes all that its predecessor kept, and what it decides takes effect. Between stages
the documents are written as Parquet and read again, so the loss of an executor repeats tasks of
one stage at most.

All stages keep every column of their rows, whatever its name, and give an empty table for an empty one. Null texts
are empty texts. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowwarden.llm import decontaminate, language, packing, quality, simhash
from rowwarden.llm.base import table
from rowwarden.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, and on condemned hosts those that fail any rule. Null and empty
    texts have no words and go; a null source is a host of its own."""
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go. The model is learned from this stage's input;
    where no row of it has a language, only documents without letters go, null texts among them. Rows without an id are not
    learned from; of equally likely languages the first in order counts."""
    return language.recognised_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the least id stays. Null and empty texts are one class. Of
    rows that share an id, or have none, one stays if no smaller id of its class does; which of equal rows is open."""
    return simhash.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go. Null and empty texts contain none; items without words are in none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their places in sequences. A null text is the end id alone; repeated rows and
    rows without an id are packed each; pieces of one length are placed in order of id and piece, equal ones in any."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints, a trained model and token ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
