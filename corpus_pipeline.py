"""From raw documents to packed training sequences, in five stages over the shared folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the
next stage's documents, so a lost executor never costs more than its stage. All stages but the last return the
columns of ``documents``.

Defined cases: documents without letters or words go in the first or second stage; without labels the base rule alone decides, without a
learnable language nothing stays; an empty table gives no sequences; more columns stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, near_dedup, packing, quality, suffix_dedup
from tessera.llm._store import checkpoint, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in one of the languages learned from the corpus."""
    return langid.keep_known(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and the trees fitted on the labelled ones."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group linked at five words and a similarity of 0.8."""
    return near_dedup.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that a document with a smaller id holds too; documents of which nothing but white space is left go."""
    return suffix_dedup.trim(docs).where(F.col("text").rlike("[^ \t-\r]"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("packing", sequences),
]

#: Trained models, exact byte cuts and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:  # what a stage has written on its way goes with it
            docs = keep(checkpoint(stage(spark, docs, sf_dir), "stage"))
    return STAGES[-1][1](spark, docs, sf_dir)
