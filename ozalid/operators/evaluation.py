"""Accuracy, strata, fallback rate, latency, bootstrap intervals, and comparisons of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(c: Column | str) -> Column:
    return F.col(c).cast("int") if isinstance(c, str) else c.cast("int")


def summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, correct, accuracy (per cent), fallback_rate (per cent), mean_time; one partial aggregation, one shuffle."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.coalesce(F.sum(flag("correct")), F.lit(0)).alias("correct_rows"), F.round(100 * F.avg(flag("correct")), 6).alias("accuracy"),
        F.round(100 * F.avg(flag("fallback_triggered")), 6).alias("fallback_rate"), F.round(F.avg("inference_time"), 4).alias("mean_time"),
    )


def strata(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, total, correct_rows, accuracy) of each key by itself and of all rows, in one pass of grouping sets."""
    view = df.select("correct", *[F.col(k).cast("string").alias(k) for k in keys])
    sets = ", ".join([*(f"({k})" for k in keys), "()"])
    which = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys) + " ELSE 'all' END"
    value = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN {k}" for k in keys) + " END"
    return df.sparkSession.sql(
        f"SELECT {which} AS key, {value} AS value, count(*) AS total, coalesce(sum(cast(correct AS int)), 0) AS correct_rows, round(100 * avg(cast(correct AS int)), 6) AS accuracy FROM {{v}} GROUP BY GROUPING SETS ({sets})",
        v=view,
    )


def bootstrap_counts(n: int, hits: int, resamples: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the accuracy in per cent. The sum of n draws with replacement of 0/1 flags is Binomial(n, hits / n),
    so resamples are drawn from that; nothing of size n x resamples exists. No rows: (0, 0)."""
    if n == 0:
        return 0.0, 0.0
    means = np.random.default_rng(seed).binomial(n, hits / n, resamples) / n
    low, high = np.percentile(means, [2.5, 97.5]) * 100
    return float(low), float(high)


def bootstrap_flags(flags: np.ndarray, resamples: int = 10_000, seed: int = 42, block: int = 100) -> tuple[float, float]:
    """The same interval by resampling the flags themselves, in blocks of draws: a run of n flags at a time, for parity
    with a direct bootstrap of small runs."""
    n = len(flags)
    if n == 0:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    values = np.asarray(flags, float)
    means = np.concatenate([values[rng.integers(0, n, (min(block, resamples - i), n))].mean(axis=1) for i in range(0, resamples, block)])
    low, high = np.percentile(means, [2.5, 97.5]) * 100
    return float(low), float(high)


def bootstrap(df: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(by..., n, hits, low, high) of df.correct; the counts are the only thing that is shuffled."""
    counts = df.groupBy(*by).agg(F.count("correct").alias("n"), F.coalesce(F.sum(flag("correct")), F.lit(0)).alias("hits"))

    @F.pandas_udf("low double, high double")
    def interval(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bootstrap_counts(int(a), int(b), resamples, seed) for a, b in zip(n, hits, strict=True)], columns=["low", "high"])

    return counts.withColumn("_i", interval("n", "hits")).select(*by, "n", "hits", "_i.low", "_i.high")


def report(log: DataFrame, requested: DataFrame, strata_of: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(key, value, requested, total, skipped, correct_rows, accuracy, low, high, fallback_rate, mean_time): all rows first,
    then each stratum, largest first. log: evaluated rows; requested: what was asked for, with the same strata; what is in
    requested and not in log was skipped. No rows: one row of zeros and NULLs.
    """

    def cells(df: DataFrame) -> DataFrame:
        each = [F.struct(F.lit("all").alias("key"), F.lit(None).cast("string").alias("value"))]
        each += [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in strata_of]
        return df.withColumn("_c", F.explode(F.array(*each)))

    by = [F.col("_c.key").alias("key"), F.col("_c.value").alias("value")]
    got = cells(log.select("correct", "fallback_triggered", "inference_time", *strata_of)).select(*by, "correct", "fallback_triggered", "inference_time")
    sums = summary(got, ["key", "value"])
    asked = cells(requested.select(*strata_of)).groupBy(*by).agg(F.count("*").alias("requested"))
    same = (F.col("a.key") == F.col("s.key")) & F.col("a.value").eqNullSafe(F.col("s.value"))
    whole = requested.sparkSession.createDataFrame([("all", None, 0)], "key string, value string, requested long")
    asked = asked.unionByName(whole).groupBy("key", "value").agg(F.sum("requested").alias("requested"))
    full = asked.alias("a").join(sums.alias("s"), same, "left").select("a.key", "a.value", "requested", *[F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in ("total", "correct_rows")], "s.accuracy", "s.fallback_rate", "s.mean_time")

    @F.pandas_udf("low double, high double")
    def interval(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bootstrap_counts(int(a), int(b), resamples, seed) for a, b in zip(n, hits, strict=True)], columns=["low", "high"])

    told = full.withColumn("skipped", F.col("requested") - F.col("total")).withColumn("_i", interval("total", "correct_rows"))
    order = [(F.col("key") != "all").cast("int"), F.col("key"), F.desc("total"), F.col("value")]
    return told.orderBy(*order).select("key", "value", "requested", "total", "skipped", "correct_rows", "accuracy", "_i.low", "_i.high", "fallback_rate", "mean_time")


def bootstrap_portable(flags: DataFrame, resamples: int, seed: int = 42) -> DataFrame:
    """(n, low, high) with index draws from md5, the same in any engine: for checks at small size, as it makes
    n x resamples rows. flags: i (0 to n - 1) and f (0 or 1), one row each."""
    spark = flags.sparkSession
    n = flags.count()
    draws = flags.select("i").crossJoin(F.broadcast(spark.range(resamples).withColumnRenamed("id", "b")))
    index = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b"), F.col("i"))), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    picked = draws.select("b", index.alias("j")).join(flags.select(F.col("i").alias("j"), "f"), "j")
    means = picked.groupBy("b").agg(F.avg("f").alias("m"))
    return means.agg(F.lit(n).cast("long").alias("n"), F.round(100 * F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(100 * F.percentile("m", F.lit(0.975)), 6).alias("high"))


def objective(accuracy: Column, mean_time: Column, k: float) -> Column:
    """Accuracy less k for each second of mean time."""
    return accuracy - F.lit(k) * mean_time


def visual_reliance(real: Column, blind: Column, chance: Column) -> Column:
    return (real - blind) / F.greatest(real - chance, F.lit(1e-6))


def mcnemar(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, statistic): queries that only one of two runs answers rightly, with continuity correction."""
    both = a.select(key, F.col("correct").alias("_a")).join(b.select(key, F.col("correct").alias("_b")), key)
    counts = both.agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))
    apart = F.abs(F.col("only_a") - F.col("only_b"))
    return counts.withColumn("statistic", F.round(F.when(F.col("only_a") + F.col("only_b") > 0, F.pow(F.greatest(apart - 1, F.lit(0)), F.lit(2)) / (F.col("only_a") + F.col("only_b"))).otherwise(0.0), 6))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(rows, ece): expected calibration error over equal-width bins of a confidence in [0, 1]."""
    binned = df.filter(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).select(F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).alias("bin"), F.col(confidence).alias("c"), flag(correct).alias("k"))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("k").alias("k"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("k"))) / F.sum("n"), 6).alias("ece"))
