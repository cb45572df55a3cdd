"""Queries of problem 2: samples of qa_items with target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.cube import MOST_TARGETS, cube_sample
from ozalid.operators.skew import latest_rows


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = spark.read.parquet(f"{sf_dir}/sample_targets.parquet")
    plans = targets.select("plan_id", "field").distinct().orderBy("plan_id").limit(MOST_TARGETS + 1).collect()
    if len(plans) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} plans")
    fields = sorted({r["field"] for r in plans})
    items = latest_rows(spark.read.parquet(f"{sf_dir}/qa_items.parquet"), "question_id", "loaded_at", fields)
    rows = items.count()
    each = F.explode(F.array(*[F.struct(F.lit(r["plan_id"]).alias("plan_id"), F.col(r["field"]).alias("category")) for r in plans]))
    members = items.select("question_id", each.alias("x")).select("x.plan_id", "x.category", F.col("question_id").alias("key"))
    return cube_sample(members.filter("category IS NOT NULL"), targets, rows)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].filter("short").select("plan_id", "field", "category")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _run(spark, sf_dir)[1]
    return report.withColumn("reached_share", F.when(F.col("size") > 0, F.col("drawn") / F.col("size")))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0].select("plan_id", "category", F.col("key").alias("question_id"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample}
_NEEDS = """
WITH q AS (SELECT DISTINCT question_id, modality_type, dataset, question_type FROM qa_items WHERE question_id IS NOT NULL),
n AS (SELECT count(DISTINCT question_id) AS n FROM q),
v AS (SELECT 'modality_type' AS field, modality_type AS category, count(DISTINCT question_id) AS available FROM q GROUP BY ALL
  UNION ALL SELECT 'dataset', dataset, count(DISTINCT question_id) FROM q GROUP BY ALL UNION ALL SELECT 'question_type', question_type, count(DISTINCT question_id) FROM q GROUP BY ALL),
t AS (SELECT t.*, floor(sample_fraction * n)::BIGINT AS size, coalesce(available, 0) AS available FROM sample_targets t CROSS JOIN n LEFT JOIN v USING (field, category))
"""
ORACLE = {"p2_found": _NEEDS + "SELECT plan_id, field, category FROM t WHERE available < greatest(ceil(target_share * size), min_rows)"}
