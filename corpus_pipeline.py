"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as written and read back, and its
decisions take effect: what it rejects is gone for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlines.llm.common import Scratch
from rasterlines.llm.decontamination import clean_documents
from rasterlines.llm.line_dedup import without_repeated_lines
from rasterlines.llm.ngram_join import one_of_each_group
from rasterlines.llm.packing import pack_documents
from rasterlines.llm.toxicity import ToxicityModel


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = ToxicityModel.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where("toxicity < 0.5").drop("toxicity")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, fuzzily; those left without a word go."""
    return without_repeated_lines(docs, Scratch(spark, "stage-lines", "lz4_raw"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs, Scratch(spark, "stage-near", "lz4_raw"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "stage-leaks", "lz4_raw"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048, Scratch(spark, "stage-packing", "lz4_raw"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Token ids and compressed lengths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline", "lz4_raw")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


QUERIES = {"pipeline": run}
QUERIES_SQL: dict[str, str] = {}
