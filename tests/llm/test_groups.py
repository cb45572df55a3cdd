import random

import pytest
from pyspark.sql import functions as F

from ozalid.llm.groups import assign_splits, case_key, connected, grouped_items, plan_sizes

CATALOG = [("CoralThorax", "CTH"), ("SlateBrain", "SLB")]


@pytest.mark.parametrize(("text", "key"), [("CTH_00000012_3", "cth:12"), ("cth-12-q03", "cth:12"), ("CoralThorax_00000012_Q3", "cth:12"), ("CTH00000012.3", "cth:12"), ("CORALTHORAX#12", "cth:12"), ("cth 00000012", "cth:12"), ("CoralThorax:12", "cth:12"), ("CoralThorax_train_12", "cth:12"), ("New_5_1", "new:5"), ("nothing", None), ("", None), (None, None), ("CTH_0", "cth:0")])
def test_case_key(spark, text, key):
    assert spark.range(1).select(case_key(F.lit(text).cast("string"), CATALOG)).first()[0] == key


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("merge_rows", [1_000_000, 5])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_connected_equals_union_find(spark, shape, merge_rows):
    rng = random.Random(3)
    pairs = {"random": [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(130)], "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "star": [("hub", f"n{i}") for i in range(80)], "empty": []}[shape]
    pairs += [(None, "x"), ("y", None), ("z", "z"), *pairs[:5], *[(b, a) for a, b in pairs[:5]]]
    got = connected(spark.createDataFrame(pairs, "a string, b string"), "a", "b", partitions=9, merge_rows=merge_rows)
    assert {r["node"]: r["root"] for r in got.collect()} == components(pairs)


def test_groups(spark):
    ids = ["CTH_00000001_1", "cth-1-q02", "SLB_5_1", "SLB_6_1", "odd", None, "SLB_6_1", "SLB_7_1"]
    items = spark.createDataFrame([(i, "x", "y") for i in ids], "question_id string, case_id string, root string")
    links = spark.createDataFrame([("CTH:1", "slb 9"), ("SlateBrain#9", "SLB-5"), ("SLB-5", "SLB-5"), (None, "SLB-6")], "case_a string, case_b string")
    got = {r["question_id"]: (r["group_id"], r["group_rows"]) for r in grouped_items(items, links, CATALOG).collect()}
    assert got == {"CTH_00000001_1": ("CTH_00000001_1", 3), "cth-1-q02": ("CTH_00000001_1", 3), "SLB_5_1": ("CTH_00000001_1", 3), "SLB_6_1": ("SLB_6_1", 1), "SLB_7_1": ("SLB_7_1", 1), "odd": ("odd", 1)}
    assert grouped_items(items.limit(0), links.limit(0), CATALOG).count() == 0


def greedy(sizes, shares):
    total = sum(s * n for s, n in sizes)
    lack = {k: total * v for k, v in shares.items()}
    for s, n in sorted(sizes, reverse=True):
        for _ in range(n):
            k = min(lack, key=lambda k: (-lack[k], k))
            lack[k] -= s
    return lack


@pytest.mark.parametrize("sizes", [[(1, 1000)], [(50, 1), (3, 40), (1, 7)], [(7, 13), (2, 999), (1, 5)], [(5, 1)], []])
def test_plan_is_as_good_as_greedy(sizes):
    shares = {"train": 0.8, "validation": 0.08, "test": 0.12}
    plan = plan_sizes(sizes, shares)
    assert {s: sum(got.values()) for s, got in plan.items()} == dict(sizes)
    total = sum(s * n for s, n in sizes)
    worst = max(abs(v) for v in greedy(sizes, shares).values()) if sizes else 0
    for k, v in shares.items():
        assert abs(sum(s * got.get(k, 0) for s, got in plan.items()) - total * v) <= worst + max([s for s, _ in sizes], default=0)


def test_splits_hold_groups(spark):
    items = spark.range(3000).selectExpr("concat('CTH_', CASE WHEN id < 1000 THEN 0 ELSE cast(id / 3 AS int) END, '_', id) AS question_id")
    links = spark.createDataFrame([], "case_a string, case_b string")
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4), (None, 1.0)], "split string, target_share double")
    got = assign_splits(items, links, targets, CATALOG)
    assert got.count() == 3000 and got.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    shares = {r["split"]: r["count"] / 3000 for r in got.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.6) < 0.01
