"""Queries of problem 7: every text as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.tokens import encode_texts


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per token by source."""
    ids = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["source", "n_chars"])
    return ids.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.round(F.sum("n_chars") / F.sum(F.size("ids")), 4).alias("chars_per_token"))


QUERIES = {"p7_ids": p7_ids, "p7_sizes": p7_sizes}
ORACLE: dict[str, str] = {}
