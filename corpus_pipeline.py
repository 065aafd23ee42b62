"""From raw documents to encoded training text: five stages that hand Parquet to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpframe.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from chirpframe.llm.common import stored, table, text_of
from chirpframe.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels in ``sf_dir``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one row stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 5-word shingle similarity of 0.8 or more, one row stays."""
    return jaccard_join.one_per_component(docs, size=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet their target shares."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text instead of the text, their number, and whether they decode to it."""
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, path, pattern, round_trip=True)
    same = F.col("decoded") == F.encode(text_of("text"), "UTF-8")
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same}).drop("text", "decoded")


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("source_mixing", source_mix),
    ("byte_bpe", encoded),
]
#: A trained score is beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
