"""Volumes in long form (one row per slice): order, scores, choice of slices, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ozalid.functions.scalars import clamp, half_even

#: How many slices are shown, their least distance as a share of the depth, the most that are scored, fixed depths.
SHOWN, LEAST_GAP, MOST_SCORED, DEPTHS = 3, 0.10, 128, (0.35, 0.50, 0.65)
LOW, HIGH = 0.005, 0.995


def fixed_depths(depth: Column) -> Column:
    """Slice indexes at fixed shares of the depth, halves to even."""
    last = depth - 1
    return F.array(*[clamp(half_even(F.lit(f) * last), F.lit(0), last).cast("int") for f in DEPTHS])


def stride(depth: Column, most: int = MOST_SCORED) -> Column:
    return F.when(depth <= most, F.lit(1)).otherwise(F.floor(depth / most).cast("int"))


def _with_group(df: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """df with aggregates of its groups: added up before the shuffle and joined, so no group is one task's; NULL is a group."""
    groups = df.groupBy(F.col(by).alias("_by")).agg(*aggregates)
    return df.join(groups, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def candidates(df: DataFrame, volume: str, index: str, most: int = MOST_SCORED) -> DataFrame:
    """The slices that are scored: all up to `most`, else every depth div most-th. Depth is max(index) + 1 per volume."""
    deep = _with_group(df, volume, (F.max(index) + 1).cast("int").alias("_d"))
    return deep.filter(F.col(index) % stride(F.col("_d"), most) == 0).drop("_d")


def min_max(df: DataFrame, volume: str, column: str, out: str) -> DataFrame:
    """df with out, the column scaled to 0..1 within its volume; 0 where it hardly varies."""
    low, high = F.col("_low"), F.col("_high")
    ranged = _with_group(df, volume, F.min(column).alias("_low"), F.max(column).alias("_high"))
    return ranged.withColumn(out, F.when(high - low <= 1e-6, F.lit(0.0)).otherwise((F.col(column) - low) / (high - low))).drop("_low", "_high")


def pick_slices(scores: DataFrame, volume: str, index: str, score: str, depth: str, k: int = SHOWN) -> DataFrame:
    """(volume, picked): k indexes of best score that lie max(1, round(0.1 * depth)) apart, ascending.

    Greedy by score (ties to the smaller index); if too few are far enough apart, the best of the others fill up;
    a volume of at most k slices gives all of them. One row per slice in, at most the scored ones per volume in a group.
    """
    every = scores.groupBy(volume).agg(F.max(depth).alias("_d"), F.collect_list(F.struct(F.col(score).alias("s"), F.col(index).cast("int").alias("i"))).alias("_l"))
    ranked = every.withColumn("_o", F.transform(F.array_sort("_l", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(F.signum(a["i"] - b["i"]).cast("int"))), lambda x: x["i"]))
    gap = F.greatest(F.lit(1), half_even(F.col("_d") * LEAST_GAP))
    nothing = F.array().cast("array<int>")
    with_gap = ranked.withColumn("_g", gap).withColumn("_a", F.aggregate("_o", nothing, lambda acc, i: F.when((F.size(acc) < k) & F.forall(acc, lambda s: F.abs(i - s) >= F.col("_g")), F.concat(acc, F.array(i))).otherwise(acc)))
    filled = F.slice(F.concat("_a", F.array_except("_o", "_a")), 1, k)
    return with_gap.select(volume, F.array_sort(F.when(F.col("_d") <= k, F.col("_o")).otherwise(filled)).alias("picked"))


def series_order(df: DataFrame, series: str, number: str, z: str, path: str, out: str = "position") -> DataFrame:
    """df with the 0-based position in its series: by number if all slices have one, else by z if all have, else by path."""
    w = Window.partitionBy(series)
    all_numbers, all_z = F.bool_and(F.col(number).isNotNull()).over(w), F.bool_and(F.col(z).isNotNull()).over(w)
    keyed = df.withColumn("_k", F.when(all_numbers, F.col(number).cast("double")).when(all_z, F.col(z).cast("double")))
    return keyed.withColumn(out, F.row_number().over(w.orderBy(F.col("_k").asc_nulls_last(), F.col(path))) - 1).drop("_k")


def majority_shape(df: DataFrame, series: str, shape: str, position: str) -> DataFrame:
    """(series, shape): the most frequent shape of a series, of equal ones the one met first."""
    counts = df.groupBy(series, shape).agg(F.count("*").alias("_n"), F.min(position).alias("_p"))
    return counts.groupBy(series).agg(F.min(F.struct(-F.col("_n"), F.col("_p"), F.col(shape))).alias("_m")).select(series, F.col(f"_m.{shape}").alias(shape))


def rescaled(value: Column, slope: Column, intercept: Column) -> Column:
    """value * slope + intercept; a missing or zero slope is 1, a missing intercept 0."""
    return value * F.coalesce(F.nullif(slope, F.lit(0.0)), F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))


def inverted(df: DataFrame, by: str, value: str, inverse: Column) -> DataFrame:
    """df with value mirrored within its range per group where inverse holds."""
    ranged = _with_group(df.withColumn("_inverse", inverse), by, F.min(value).alias("_low"), F.max(value).alias("_high"))
    return ranged.withColumn(value, F.when(F.col("_inverse"), F.col("_high") + F.col("_low") - F.col(value)).otherwise(F.col(value))).drop("_low", "_high", "_inverse")


def window_bounds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., lo, hi, least, most): exact 0.5 and 99.5 percentiles with linear interpolation, and the range."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(LOW)).alias("lo"), F.percentile(value, F.lit(HIGH)).alias("hi"), F.min(value).alias("least"), F.max(value).alias("most"))


def to_byte(value: Column, lo: Column, hi: Column, least: Column, most: Column) -> Column:
    """value in 0..255 by the window lo..hi, cut off after the point; by the whole range where the window is empty."""
    span = F.when(most > least, most - least).otherwise(F.lit(1.0))
    plain = (value - least) / span * 255.0
    inside = (clamp(value, lo, hi) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255.0
    return F.when(hi <= lo, plain).otherwise(inside).cast("int")


# Keywords of a question and the (centre, width) of the CT window that shows what it asks about.
CT_WINDOWS = (
    (("lung", "pulmonary", "nodule", "pneumothorax", "emphysema"), (-600, 1500)),
    (("brain", "cerebral", "hemorrhage", "stroke", "ventricle"), (40, 80)),
    (("bone", "fracture", "vertebra", "cortical", "lytic"), (400, 2000)),
    (("liver", "kidney", "spleen", "abdomen", "bowel"), (60, 400)),
)


def keyword_window(question: Column) -> Column:
    """struct<lo, hi> of the first window with a keyword in the question, NULL if none has one."""
    out = F.lit(None).cast("struct<lo: int, hi: int>")
    for words, (centre, width) in reversed(CT_WINDOWS):
        bounds = F.struct(F.lit(centre - width // 2).alias("lo"), F.lit(centre + width // 2).alias("hi"))
        out = F.when(F.lower(question).rlike("|".join(words)), bounds).otherwise(out)
    return out
