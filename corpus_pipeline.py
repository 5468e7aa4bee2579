"""The corpus pipeline: reject toxic documents, drop repeated lines, keep one of each group of near copies, mix the
sources to their weights, pack.

STAGES lists the stages in order; each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a
stage returns as Parquet in the shared folder and reads it again as the next one's docs. Rows of `documents` whose
columns hold nulls pass every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import chosen_path, line_dedup, mixing, packing, toxicity
from siteloom.llm.common import new_path, release, scope
from siteloom.llm.queries import BYTE_BPE


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model is trained on the labelled rows of these documents."""
    return toxicity.apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters that 5 or more documents hold stay in the largest doc_id only."""
    return line_dedup.apply(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets that are 0.8 or more alike."""
    return chosen_path.apply(docs, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.digest(docs, BYTE_BPE)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: SQL cannot train the classifier or run the tokenizer; tests/llm/test_pipeline.py holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        # What a stage kept on its way goes when its own table is written.
        path = new_path(spark, f"stage-{name}")
        with scope():
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        docs.kept_path = path
        if last is not None:
            release(last)
        last = docs
    return docs
