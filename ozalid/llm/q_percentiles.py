"""Queries of problem 6: percentiles of run times and logit margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.percentiles import classify, digit_counts, percentiles, percentiles_of_counts, with_number
from ozalid.session import cut_lineage


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (metric, grp, day, v, status) of the three measured columns; one scan of each table. Every row is a measurement."""
    return _long(spark.read.parquet(f"{sf_dir}/predictions.parquet"), spark.read.parquet(f"{sf_dir}/diagnostics.parquet"))


def _long(predictions: DataFrame, d: DataFrame) -> DataFrame:
    p = with_number(predictions, "inference_time", "seconds")
    blank = F.col("inference_time").isNull() | (F.trim("inference_time") == "")
    one = p.select(F.lit("predictions.inference_time").alias("metric"), F.col("run_id").alias("grp"), F.to_date("written_at").alias("day"), F.col("seconds").alias("v"), blank.alias("m"))
    both = F.explode(F.array(F.struct(F.lit("diagnostics.logit_margin").alias("metric"), F.col("logit_margin").alias("v")), F.struct(F.lit("diagnostics.inference_time").alias("metric"), F.col("inference_time").alias("v"))))
    two = d.select(both.alias("x"), F.col("modality").alias("grp"), F.to_date("logged_at").alias("day")).select("x.metric", "grp", "day", "x.v", F.col("x.v").isNull().alias("m"))
    return one.unionByName(two).select("metric", "grp", "day", "v", classify(F.col("v"), F.col("m")).alias("status"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(measurements(spark, sf_dir), ["metric", "grp"], "v", "status")


def p6_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_percentiles, but of rows with the same query and run only the latest counts (of equal times the greatest value).
    Such rows are found over all pieces, so this needs the rows and can't be added up from stored pieces."""
    p, d = spark.read.parquet(f"{sf_dir}/predictions.parquet"), spark.read.parquet(f"{sf_dir}/diagnostics.parquet")
    p = p.groupBy("query_id", "run_id").agg(F.max(F.struct("written_at", "inference_time")).alias("x")).select("run_id", "x.*")
    d = d.groupBy("query_id", "run_id").agg(F.max(F.struct("logged_at", "modality", "logit_margin", "inference_time")).alias("x")).select("run_id", "x.*")
    return percentiles(cut_lineage(_long(p, d)), ["metric", "grp"], "v", "status")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each day: counts by the first 22 bits of the keys (relative error below 2**-10)."""
    return digit_counts(measurements(spark, sf_dir), ["metric", "grp", "day"], "v", "status", bits=22)


def p6_from_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all days from the days' counts alone."""
    return percentiles_of_counts(p6_pieces(spark, sf_dir), ["metric", "grp"], bits=22).withColumn("within", F.col("upper") <= F.col("value") * (1 + F.col("max_relative_error"))).select("metric", "grp", "percentile", "n_valid", "value", "within")


QUERIES = {"p6_percentiles": p6_percentiles, "p6_latest": p6_latest, "p6_pieces": p6_pieces, "p6_from_pieces": p6_from_pieces}

_LONG = """
WITH m AS (
  SELECT 'predictions.inference_time' AS metric, run_id AS grp, TRY_CAST(inference_time AS DOUBLE) AS v, inference_time IS NULL OR trim(inference_time) = '' AS m FROM predictions
  UNION ALL SELECT 'diagnostics.logit_margin', modality, logit_margin, logit_margin IS NULL FROM diagnostics
  UNION ALL SELECT 'diagnostics.inference_time', modality, inference_time, inference_time IS NULL FROM diagnostics
), s AS (
  SELECT *, CASE WHEN m THEN 'missing' WHEN v IS NULL THEN 'unreadable' WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'infinite' WHEN v < 0 THEN 'negative' ELSE 'ok' END AS status FROM m
), t AS (
  SELECT metric, grp, count(*) FILTER (status = 'ok') AS n_valid, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'unreadable') AS n_unreadable,
    count(*) FILTER (status = 'nan') AS n_nan, count(*) FILTER (status = 'infinite') AS n_infinite, count(*) FILTER (status = 'negative') AS n_negative FROM s GROUP BY ALL
), r AS (
  SELECT metric, grp, v, row_number() OVER (PARTITION BY metric, grp ORDER BY v) AS i FROM s WHERE status = 'ok'
), q AS (SELECT * FROM (VALUES (0.5::DOUBLE, 500), (0.9::DOUBLE, 900), (0.99::DOUBLE, 990), (0.999::DOUBLE, 999)) x(percentile, num))
"""
_RESULT = """
SELECT t.metric, t.grp, q.percentile, r.v AS value, 0.0::DOUBLE AS max_relative_error, n_valid, n_missing, n_unreadable, n_nan, n_infinite, n_negative
FROM t CROSS JOIN q LEFT JOIN r ON r.metric = t.metric AND r.grp IS NOT DISTINCT FROM t.grp AND r.i = greatest(1, (q.num * t.n_valid + 999) // 1000)"""
_LATEST = """
WITH lp AS (SELECT run_id, inference_time FROM predictions QUALIFY row_number() OVER (PARTITION BY query_id, run_id ORDER BY written_at DESC NULLS LAST, inference_time DESC NULLS LAST) = 1),
ld AS (SELECT modality, logit_margin, inference_time FROM diagnostics QUALIFY row_number() OVER (PARTITION BY query_id, run_id ORDER BY logged_at DESC NULLS LAST, modality DESC NULLS LAST, logit_margin DESC NULLS LAST, inference_time DESC NULLS LAST) = 1),
"""
ORACLE = {"p6_percentiles": _LONG + _RESULT, "p6_latest": _LATEST + _LONG.replace("WITH m", "m").replace("FROM predictions", "FROM lp").replace("FROM diagnostics", "FROM ld") + _RESULT}
