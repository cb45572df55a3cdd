"""Queries of problem 1: values of dev_metadata that were decoded in the wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.garbled import garbled
from ozalid.operators.skew import join_by_share, latest_rows
from ozalid.session import cut_lineage

FIELDS = ("question", "choice_A", "choice_B")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_rows(spark.read.parquet(f"{sf_dir}/dev_metadata.parquet"), "query_id", "loaded_at", list(FIELDS))
    long = rows.select("query_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("query_id", "x.*").filter("value IS NOT NULL")
    long = cut_lineage(long)
    return join_by_share(long, garbled(long.select("value")), "value", "copies", long.count())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("query_id", "field")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected values with their original text, NULL where nothing of it can be known."""
    return _found(spark, sf_dir).select("query_id", "field", "value", "restored")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
ORACLE: dict[str, str] = {}
