"""Queries of problem 8: mixtures of documents with target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ozalid.llm.mix import mixture
from ozalid.llm.tokens import count_tokens


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id", "source"])
    return mixture(sized, spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].filter("short").select("plan_id", "source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_mixture": p8_mixture}
ORACLE: dict[str, str] = {}
