"""The corpus pipeline: quality, near copies, repeated passages, source mix, piece ids.

Each stage is a function of (spark, docs, sf_dir). `run` writes each stage's rows as Parquet into the shared folder
and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import mixing, pieces, simhash, sites, suffixes
from pixelweave.llm.common import table
from pixelweave.llm.places import fresh_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site classifier does not reject."""
    return sites.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur again."""
    return suffixes.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", passages),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", encode),
]

# the classifier, the fingerprints and the best segmentations are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_folder(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
