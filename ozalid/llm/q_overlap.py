"""Queries of problem 3: items of the evaluation splits that are also in train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.overlap import overlaps, prepare
from ozalid.operators.skew import latest_rows
from ozalid.session import cut_lineage


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = latest_rows(spark.read.parquet(f"{sf_dir}/qa_items.parquet"), "question_id", "loaded_at", ["dataset", "question", "image_path", "split"])
    return overlaps(cut_lineage(prepare(items)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.least("train_id", "eval_id").alias("question_id_1"), F.greatest("train_id", "eval_id").alias("question_id_2"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and evaluation items concerned, per split and the two datasets."""
    return _pairs(spark, sf_dir).groupBy("eval_split", "eval_dataset", "train_dataset").agg(F.count("*").alias("pairs"), F.count_distinct("eval_id").alias("items"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLE: dict[str, str] = {}
