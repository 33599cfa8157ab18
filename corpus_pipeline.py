"""A corpus pipeline over the training-data operators: reject bad, then toxic documents, keep one of each group of near
duplicates, and pack what is left.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents (others go, whatever their names). Models are fitted on the labels of sf_dir. Stages take null texts as empty and
texts whole, rows with a null id are judged like others, repeated rows are judged alike and one of them stays after the
third stage, a score at a threshold counts as reaching it, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import near_dedup, nbsvm, packing, toxicity
from stowage.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = nbsvm.quality(spark, docs.select(*COLUMNS), sf_dir, COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't called toxic."""
    tagged = toxicity.tag(docs.select(*COLUMNS), toxicity.model_of(spark, sf_dir), COLUMNS, spans=False)
    return tagged.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return near_dedup.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by power-of-two decomposition."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packed)]
#: Models and signatures are beyond SQL; tests hold the pipeline against its stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again; the tables go with the session."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
