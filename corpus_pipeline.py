"""From raw documents to packed training windows, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return
the columns of documents; the last one returns windows of document pieces.

Defined results, stage by stage. Null, empty and wordless texts: language ID rejects them, so no later stage sees them in run(); given to a later stage by itself, exact dedup keeps null
texts and one of the empty ones, the Jaccard join and decontamination keep all, and packing places them as pieces of 0 words. Long texts are taken whole everywhere. Ties: the alphabetically
first language, the smallest id of copies and of near copies; a null id comes after all others among exact copies, and is never judged by the Jaccard join. Rows that repeat, id and all, are
exact copies, of which one stays; rows that share an id with other texts are judged one by one, but the Jaccard join drops or keeps the rows of a partition under one id together. Empty tables pass
through as empty. Further columns, of any name, are passed on by the first four stages and ignored by packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import common, decontaminate, exact_dedup, jaccard_join, langid, related_packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of; the rest goes."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of byte-for-byte copies, that with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group whose word n-grams overlap by the join's threshold, that with the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that was nothing else goes, all others stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def related_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents: every word of every document that is left, in one window each."""
    return related_packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", related_windows),
]

#: Neither the language model nor the packing walk can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
