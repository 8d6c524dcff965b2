"""From raw documents to token ids: reject, clean, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before
kept; all but the last return the columns of ``documents``. Nulls, empty and very long
texts, repeated rows and empty tables pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revaxis.llm import bpe, mixing, pairwise_quality, set_join, site_lines
from revaxis.llm.common import free_name, word_count, written
from revaxis.llm.queries import table, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").where(pairwise_quality.training_part(F.col("doc_id")))
    return pairwise_quality.keep_good(docs, pairwise_quality.learn_quality(docs, labels))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents of their source contain; no document goes.

    Copies and near copies count as one document there: they are left to the next stage.
    """
    clean = site_lines.drop_boilerplate(docs, "source", "text", copies_once=True, small_hosts=True)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return set_join.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by words takes them."""
    size = free_name(docs, "size")
    mixed = mixing.mix(
        docs.withColumn(size, word_count(F.col("text"))), size=size, source="source", doc_id="doc_id",
        weight=mixing.repeating_weights,
    )
    return mixed.select(*(f"`{c}`" for c in docs.columns))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, packed, and the text decoded from them."""
    coded = bpe.encode_documents(docs, vocabulary())
    return coded.withColumn("text", F.col("decoded")).drop("decoded")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources to target weights", mixed_documents),
    ("BPE encoding and decoding", encoded_documents),
]

#: A learnt classifier and hashed draws are not for SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
