"""Joins, ranks and row choices that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with at least 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are: the bound of what is broadcast.
HOT_SHARE = 1000


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest (order, columns...). Rows with a null key are left out.

    Partial aggregation runs before the shuffle, so a key with very many rows costs no more than any other.
    """
    columns = columns if columns is not None else [c for c in df.columns if c not in (key, order)]
    top = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("_top")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, "_top.*")


def join_by_share(big: DataFrame, table: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """big joined to table (unique on key, column `rows` = rows of big with this key), split by the key's share.

    Keys with 1/HOT_SHARE of all rows or more are broadcast, at most HOT_SHARE of them; all others shuffle.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("how must be inner or left_semi")
    least = max(1, total // HOT_SHARE)
    hot, cold = table.filter(F.col(rows) > least), table.filter(F.col(rows) <= least)
    marks = F.broadcast(hot.select(key))
    one = big.join(F.broadcast(hot.drop(rows)), key, how)
    other = big.join(marks, key, "left_anti").join(cold.drop(rows), key, how)
    return one.unionByName(other)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", buckets: int = 64) -> DataFrame:
    """A 1-based rank within keys in a seeded order, without gathering a hot key in one task.

    order[0] must be an integer hash: its value modulo nothing but its range decides the bucket, so that ranks follow
    the order over buckets as well. Counts per (keys, bucket) give each bucket's offset; only within a bucket rows are sorted.
    """
    first = order[0]
    tagged = df.withColumn("_b", F.floor((F.shiftrightunsigned(first.cast("long"), 40)) / F.lit(float(2**24)) * buckets).cast("int"))
    counts = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = tagged.withColumn("_r", F.row_number().over(within))
    on = [tagged_key.eqNullSafe(offset_key) for tagged_key, offset_key in ((F.col(f"l.{k}"), F.col(f"r.{k}")) for k in [*keys, "_b"])]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = ranked.alias("l").join(offsets.alias("r"), condition)
    return joined.select("l.*", F.col("r._o").alias("_o")).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")
