"""Queries of problem 9: documents that were cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.cutoff import truncated


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cut ones and their share per source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = truncated(docs, "text", ["source"]).groupBy("source").agg(F.count("*").alias("cut"))
    filled = docs.filter(F.col("text").rlike(r"\S")).groupBy("source").agg(F.count("*").alias("documents"))
    joined = filled.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select("d.source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("share"))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut document with its last sentence or line and a longer one elsewhere that goes on where it stops."""
    return truncated(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"], evidence=True)


QUERIES = {"p9_found": p9_found, "p9_evidence": p9_evidence, "p9_report": p9_report}
ORACLE: dict[str, str] = {}
