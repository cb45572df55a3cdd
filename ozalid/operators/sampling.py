"""Seeded order, limits, case splits and other choices of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ozalid.functions.scalars import seeded_hash
from ozalid.session import cut_lineage


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash (ties by key); 0 means all rows. A top-k, so each task keeps n rows at most."""
    if n == 0:
        return df
    return df.orderBy(seeded_hash(seed, F.col(key)), F.col(key)).limit(n)


def case_split(df: DataFrame, case: str, fraction: float, seed: int, by: str | None = None) -> DataFrame:
    """df with split: eval for max(1, round half-even(n * fraction)) of the n distinct cases, train for the others.

    by: a split of its own per value. Only the distinct cases are ranked, never the rows; NULL cases go to train.
    """
    keys = [by] if by else []
    cases = df.filter(F.col(case).isNotNull()).select(*keys, case).distinct().withColumn("_h", seeded_hash(seed, F.col(case)))
    if by:
        rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", case))
        n = F.count("*").over(Window.partitionBy(by))
        ranked = cases.withColumns({"_r": rank, "_n": n})
        chosen = ranked.filter(F.col("_r") <= F.greatest(F.lit(1), F.rint(F.col("_n") * fraction))).drop("_r", "_n")
    else:
        total = cases.count()
        evals = max(1, int(round(total * fraction))) if total else 0
        chosen = global_rank(cases, ["_h", case], "_r").filter(F.col("_r") <= evals).drop("_r")
    marked = chosen.select(*keys, case).withColumn("_e", F.lit(True))
    return df.join(marked, [*keys, case], "left").withColumn("split", F.when(F.col("_e"), "eval").otherwise("train")).drop("_e")


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by order; an aggregate of structs, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    keyed = df.select(*by, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest).alias("_s"))
    return keyed.groupBy(*by).agg(F.min("_s").alias("_s")).select(*by, *[F.col(f"_s.{c}").alias(c) for c in rest])


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with its 1-based rank in the order of unique columns, without one task sorting it all: range partitions, a
    count per partition, offsets from those counts."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    at, offsets = 0, []
    for p in range(parts):
        offsets.append((p, at))
        at += sizes.get(p, 0)
    table = spark.createDataFrame(offsets, "_p int, _o long")  # one row per partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_w", within).join(F.broadcast(table), "_p").withColumn(out, F.col("_w") + F.col("_o")).drop("_p", "_w", "_o")


def numbered_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with question_id '<name>_00000', '<name>_00001', ... in the order of a unique column."""
    return global_rank(df, [order], "_r").withColumn("question_id", F.format_string(f"{name}_%05d", F.col("_r") - 1)).drop("_r")


def overlap_by_hash(left: DataFrame, right: DataFrame, content: str) -> DataFrame:
    """Rows of left whose content (text or bytes) also stands in right, by SHA-256."""
    seen = right.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("_h")).distinct()
    return left.withColumn("_h", F.sha2(F.col(content).cast("binary"), 256)).join(seen, "_h", "left_semi").drop("_h")


def shuffled_choices(choices: Column, seed: int, epoch: int | Column, key: Column) -> Column:
    """choices in a seeded order per epoch, relettered A, B, ...; the old letter stays as `was`."""
    number = epoch if isinstance(epoch, Column) else F.lit(epoch)
    hashed = F.transform(choices, lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), number.cast("string"), key, c["letter"])).alias("h"), c["letter"].alias("was"), c["text"].alias("text")))
    return F.transform(F.array_sort(hashed), lambda c, i: F.struct(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)).alias("letter"), c["text"].alias("text"), c["was"].alias("was")))
