"""Small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only; a null text reads as empty. Other columns, whatever their names, stay out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def unit(doc_id: Column, text: Column) -> list[Column]:
    """The key that names a row by what it holds: rows equal in both columns share it, and share every result.

    It depends on the row alone, so a recomputed task gives the same key.
    """
    return [F.coalesce(doc_id, F.lit(-1)).alias("u1"), F.xxhash64(doc_id.isNull(), text).alias("u2")]


def packed(docs: DataFrame) -> DataFrame:
    """The whole input row as one struct ``row``, so that no column of it can clash with a working column."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))


# rows up to which a table of sites or sources is broadcast
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast where its counted rows are few; beyond that it joins by shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df
