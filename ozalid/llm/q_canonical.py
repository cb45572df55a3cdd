"""Queries of problem 5: free values mapped to the entries of answer_terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.llm.canonical import map_values, use_counts
from ozalid.operators.skew import latest_rows
from ozalid.session import cut_lineage

FIELDS = ("gt_answer", "option_A", "modality_type")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, field, value, term_id) of every value that isn't null, blank, an entry as written or a bare letter."""
    terms = spark.read.parquet(f"{sf_dir}/answer_terms.parquet")
    items = cut_lineage(latest_rows(spark.read.parquet(f"{sf_dir}/qa_items.parquet"), "question_id", "loaded_at", list(FIELDS)))
    long = items.select("question_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("question_id", "x.*")
    letter = (F.col("field") == "gt_answer") & F.col("value").rlike(r"^\s*[A-Da-d]\s*$")
    written = terms.filter("name IS NOT NULL").select(F.col("name").alias("value")).distinct()
    cases = long.filter(F.col("value").rlike(r"\S") & ~letter).join(written, "value", "left_anti")
    return map_values(cases, "value", terms, used=use_counts(items, list(FIELDS), terms))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).filter("term_id IS NOT NULL").select("question_id", "field", "term_id")


def p5_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with how many items have them."""
    return mapped(spark, sf_dir).filter("term_id = 0").groupBy("field", "value").agg(F.count("*").alias("items"))


QUERIES = {"p5_found": p5_found, "p5_misses": p5_misses}
ORACLE: dict[str, str] = {}
