"""Queries of problem 4: new splits that keep cases and linked cases together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.groups import assign_splits, grouped_items, read_catalog


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/qa_items.parquet"), spark.read.parquet(f"{sf_dir}/case_links.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links = _tables(spark, sf_dir)
    return grouped_items(items, links, read_catalog(spark, sf_dir)).filter("group_rows >= 2").select("question_id", "group_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links = _tables(spark, sf_dir)
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet")
    return assign_splits(items, links, targets, read_catalog(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share per split."""
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet")
    got = p4_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("items"), F.count_distinct("group_id").alias("groups"))
    total = got.agg(F.sum("items").alias("total"))
    return targets.join(got, "split", "left").crossJoin(F.broadcast(total)).select("split", "target_share", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("items", F.lit(0)) / F.col("total")).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_report": p4_report}
ORACLE = {
    "p4_found": """
WITH RECURSIVE names AS (SELECT lower(family) AS name, lower(code) AS code FROM dataset_catalog UNION SELECT lower(code), lower(code) FROM dataset_catalog),
q AS (SELECT DISTINCT question_id AS id, lower(regexp_extract(question_id, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 1)) AS f, regexp_extract(question_id, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 2) AS k FROM qa_items),
qc AS (SELECT id, coalesce(code, f) || ':' || k AS c FROM q LEFT JOIN names ON name = f),
l AS (SELECT lower(regexp_extract(case_a, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 1)) AS fa, regexp_extract(case_a, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 2) AS ka,
  lower(regexp_extract(case_b, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 1)) AS fb, regexp_extract(case_b, '^([A-Za-z]+)[^A-Za-z0-9]*0*([0-9]+)', 2) AS kb FROM case_links WHERE case_a IS NOT NULL AND case_b IS NOT NULL),
lc AS (SELECT coalesce(x.code, fa) || ':' || ka AS a, coalesce(y.code, fb) || ':' || kb AS b FROM l LEFT JOIN names x ON x.name = fa LEFT JOIN names y ON y.name = fb),
e AS (SELECT a, b FROM lc UNION SELECT b, a FROM lc),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
root AS (SELECT n, min(m) AS m FROM r GROUP BY n),
g AS (SELECT id, coalesce(m, c) AS m FROM qc LEFT JOIN root ON n = c),
s AS (SELECT m, min(id) AS group_id, count(*) AS k FROM g GROUP BY m)
SELECT id AS question_id, group_id FROM g JOIN s USING (m) WHERE k >= 2""",
}
