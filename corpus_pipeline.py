"""A corpus pipeline: quality rules, near-duplicate removal, mixing by source, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.  All
but the last return the columns that they were given.  Defined results: a stage passes every column on, whatever its
name; a null text fails the quality rules; where ids repeat or are missing, one row of each class of texts stays; texts
are read whole, whatever their length; an empty table stays empty; the last stage returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, quality
from tidemark.llm.queries import vocabulary
from tidemark.llm.scratch import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that failed."""
    return quality.keep_good(docs, text="text", cleaned=True, length="n_chars" if "n_chars" in docs.columns else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 80 % of their five-word shingles."""
    return jaccard.keep_one(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to the square roots of their sizes."""
    return mixing.mix(docs, seed=17)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens."""
    return packing.pack_texts(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packed)]

#: Stages 2 and 4 have no SQL form: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
