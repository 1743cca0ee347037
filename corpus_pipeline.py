"""The corpus pipeline: five stages, each from documents to documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siloway.llm.bpe import default_tokenizer, encode_documents
from siloway.llm.common import apart, table, together, written
from siloway.llm.exact_dedup import drop_exact_duplicates
from siloway.llm.minhash import drop_near_duplicates
from siloway.llm.mixing import mix_sources
from siloway.llm.quality import keep_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker, fitted on the labelled ones among them, does not reject.

    Null texts are judged as empty ones; of repeated rows all stay or none; without labelled rows of both kinds all stay.
    """
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts: that with the largest id.

    Null and empty texts are one class; rows that repeat an id that stays all stay; a null id stays in a class of null ids.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id.

    Null and empty texts are one class; rows that repeat an id that stays all stay; rows without an id stay.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the tempered weights of their sources, in a global random order.

    A null source is a source, null ids and texts are repeated like others, and equal rows get equal counts.
    """
    df, back = apart(docs)
    return together(mix_sources(df).select(*df.columns), back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of their decoding; the text is left behind.

    Null and empty texts have no tokens; repeated rows are encoded alike; all other columns stay.
    """
    df, back = apart(docs, "text")
    return together(encode_documents(df, default_tokenizer(), hold=False).drop("text"), back)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("bpe", encode)]

#: No SQL expresses the ranker, the near-duplicate classes or BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
