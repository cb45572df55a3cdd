import pytest
from pyspark.sql import functions as F

from ozalid.llm.cube import cube_sample, flight, needs

SHAPE = "plan_id string, field string, category string, target_share double, min_rows long, sample_fraction double"


def targets(spark, *rows, fraction=0.5):
    return spark.createDataFrame([("p", "f", c, s, m, fraction) for c, s, m in rows], SHAPE)


def test_needs():
    plan = [dict(plan_id="p", field="f", category=c, target_share=s, min_rows=m, sample_fraction=0.5, available=a) for c, s, m, a in (("a", 0.5, 1, 1000), ("b", 0.3, 20, 5), ("c", 0.2, 30, 1000), ("d", 0.0, 3, 0))]
    got = {r["category"]: r for r in needs(plan, 200)}
    assert (got["a"]["needed"], got["b"]["needed"], got["c"]["needed"]) == (50, 30, 30)
    assert [c for c in got if got[c]["draw"] + got[c]["gave_way"] < got[c]["needed"]] == ["b", "d"]
    assert sum(r["draw"] for r in got.values()) == 100


def test_flight_keeps_sums():
    for x in range(1, 10):
        for y in range(1, 10):
            still, keys = flight(("a", 1, x), ("b", 2, y), 10, 0)
            assert (still[2] if still else 0) + 10 * len(keys) == x + y


@pytest.mark.parametrize("parts", ["1", "5", "70"])
def test_sample_has_the_drawn_numbers(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        members = spark.range(3000).selectExpr("'p' AS plan_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN 'b' WHEN id % 2 = 0 THEN 'c' END AS category", "cast(id AS string) AS key", "id AS num", "'x' AS den")
        sample, report = cube_sample(members, targets(spark, ("hot", 0.1, 1), ("b", 0.5, 1), ("c", 0.3, 1), ("gone", 0.1, 2)), 3000, seed=3)
        rows = {r["category"]: r for r in report.collect()}
        assert all(r["residual"] == 0 for r in rows.values()) and rows["gone"]["short"] and rows["gone"]["available"] == 0
        assert sample.count() == sum(r["draw"] for r in rows.values()) == sample.select("key").distinct().count()
        assert {tuple(r) for r in sample.collect()} == {tuple(r) for r in cube_sample(members, targets(spark, ("hot", 0.1, 1), ("b", 0.5, 1), ("c", 0.3, 1), ("gone", 0.1, 2)), 3000, seed=3)[0].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_probabilities_are_equal_within_a_category(spark):
    members = spark.range(60).selectExpr("'p' AS plan_id", "'a' AS category", "cast(id AS string) AS key")
    n = [0] * 60
    for seed in range(25):
        for r in cube_sample(members, targets(spark, ("a", 1.0, 1)), 60, seed)[0].collect():
            n[int(r["key"])] += 1
    assert sum(n) == 25 * 30 and 3 <= min(n) and max(n) <= 22


def test_empty(spark):
    members = spark.createDataFrame([], "plan_id string, category string, key string")
    sample, report = cube_sample(members, targets(spark, ("a", 1.0, 2)), 0)
    assert sample.count() == 0 and report.filter(F.col("short")).count() == 1


def test_short_is_read_from_the_sample(spark):
    """Minimums above the size make categories give way: that alone is not short; too few rows are."""
    members = spark.range(100).selectExpr("'p' AS plan_id", "CASE WHEN id < 60 THEN 'a' WHEN id < 95 THEN 'b' ELSE 'c' END AS category", "cast(id AS string) AS key")
    rows = {r["category"]: r for r in cube_sample(members, targets(spark, ("a", 0.9, 1), ("b", 0.4, 1), ("c", 0.1, 20)), 100)[1].collect()}
    assert rows["c"]["short"] and rows["c"]["drawn"] == 5 and not rows["a"]["short"] and not rows["b"]["short"]
    assert sum(r["drawn"] for r in rows.values()) == 50 and rows["a"]["gave_way"] + rows["b"]["gave_way"] > 0
