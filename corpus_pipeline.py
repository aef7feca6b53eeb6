"""A corpus from raw documents to packed sequences: quality, near copies, repeated passages, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents: other columns, whatever their names, go, and missing ones are null. No stage fails on empty
tables; what each makes of nulls, empty and repeated rows and ties stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import bagminhash, common, line_crf, packing, pii_surrogates, superkmer_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on the labels, doesn't reject.

    A null or empty text scores the share of good labels and stays or goes with it; rows that repeat get one score; ids
    may be null. Without labels of both kinds nothing is told apart, and all score that share.
    """
    return line_crf.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id.

    Rows that repeat that id and text all stay, and so do texts without words, null or not; a row without doc_id goes if
    its class has one with it.
    """
    return bagminhash.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier, by doc_id (null last) and place.

    A null text stays null; rows with one id and text are one document, and rows with one id and different texts follow
    each other in the order of a hash. A document whose words all go stays, with an empty text.
    """
    return superkmer_dedup.deduplicate(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets.

    Null and empty texts stay as they are; equal texts get equal surrogates, and different entities different ones.
    """
    return pii_surrogates.replace(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    A null or empty text is one token, the end's; rows that repeat are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("substring dedup", passages), ("pii", private_data), ("packing", pack)]
#: Learned models, vocabulary files and keyed surrogates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written in the shared folder and read again; a stage's folder goes once the next one is written."""
    docs, before = common.only(common.read_table(spark, sf_dir, "documents"), **common.DOCUMENT_COLUMNS), None
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
