import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ozalid.llm import percentiles as P

RNG = np.random.default_rng(7)


def frame(spark, values, groups=None):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in zip(groups or ["g"] * len(values), values, strict=True)], "g string, v double")
    return df.withColumn("s", P.classify(F.col("v")))


def nearest(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * 1000) * len(values) / 1000)) - 1] if values else None


def test_keys_keep_order_and_come_back(spark):
    v = np.concatenate([RNG.integers(0, 2**63 - 1, 2000).view(np.float64), -RNG.random(500), [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, 2.0, 3.0]])
    v = v[np.isfinite(v)]
    rows = P.with_key(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", "k").select("v", "k", P.key_value(F.col("k")).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in rows)
    assert [r["v"] for r in sorted(rows, key=lambda r: r["k"])] == sorted(r["v"] for r in rows)


@pytest.mark.parametrize("values", [RNG.lognormal(size=3000), np.round(RNG.random(999), 1), [1.5], [0.0] * 50, RNG.integers(0, 3, 100), list(RNG.random(200)) + [1e300] * 3])
def test_exact(spark, values):
    got = {r["percentile"]: r["value"] for r in P.percentiles(frame(spark, values), ["g"], "v", "s").collect()}
    assert got == {float(p): nearest(list(map(float, values)), float(p)) for p in P.PERCENTILES}


def test_groups_and_what_is_counted_apart(spark):
    values = [1.0, 2.0, None, float("nan"), float("inf"), -1.0, 5.0, None]
    groups = ["a", "a", "a", "a", "a", "a", None, "b"]
    rows = {(r["g"], r["percentile"]): r for r in P.percentiles(frame(spark, values, groups), ["g"], "v", "s", ("0.5",)).collect()}
    a = rows["a", 0.5]
    assert (a["value"], a["n_valid"], a["n_missing"], a["n_nan"], a["n_infinite"], a["n_negative"]) == (1.0, 2, 1, 1, 1, 1)
    assert rows[None, 0.5]["value"] == 5.0 and rows["b", 0.5]["value"] is None and rows["b", 0.5]["n_missing"] == 1
    assert P.percentiles(frame(spark, []), ["g"], "v", "s").count() == 0


def test_fewer_rounds_and_the_shuffle_path(spark, monkeypatch):
    values = RNG.lognormal(size=500)
    for rounds in (1, 2, 3):
        for r in P.percentiles(frame(spark, values), ["g"], "v", "s", rounds=rounds).collect():
            want = nearest(list(values), r["percentile"])
            assert r["value"] <= want <= r["value"] * (1 + r["max_relative_error"])
    monkeypatch.setattr(P, "MOST_BROADCAST_TARGETS", 0)
    got = {r["percentile"]: r["value"] for r in P.percentiles(frame(spark, values), ["g"], "v", "s").collect()}
    assert got == {float(p): nearest(list(values), float(p)) for p in P.PERCENTILES}


def test_pieces_add_up(spark):
    df = frame(spark, list(RNG.lognormal(size=600))).withColumn("day", (F.rand(1) * 5).cast("int"))
    pieces = P.digit_counts(df, ["g", "day"], "v", "s", bits=22)
    whole = {r["percentile"]: r["value"] for r in P.percentiles(df, ["g"], "v", "s", pieces=["day"]).collect()}
    for r in P.percentiles_of_counts(pieces, ["g"], 22).collect():
        assert r["value"] <= whole[r["percentile"]] < r["upper"] <= r["value"] * (1 + r["max_relative_error"])


@pytest.mark.parametrize(("text", "want"), [("0.5", 0.5), (" 1e-3 ", 0.001), ("+2.", 2.0), ("nan", "nan"), ("inf", math.inf), ("timeout", None), ("", None), (None, None), ("1d", None), ("0x1p3", None), ("1,5", None)])
def test_numbers(spark, text, want):
    got = P.with_number(spark.createDataFrame([(text,)], "t string"), "t", "n").first()["n"]
    assert ("nan" if got is not None and math.isnan(got) else got) == want
