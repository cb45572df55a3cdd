"""Image cells resolved to files: ordered candidates, then names with a download number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ozalid.functions.scalars import file_name, file_suffix, strip

NUMBERED = r" \([0-9]+\)(\.[^.]+)$"


def _first_existing(df: DataFrame, key: str, candidates: list, listing: DataFrame) -> DataFrame:
    """(key, path): the first candidate that is in listing(path)."""
    each = df.select(key, F.posexplode(F.array(*candidates)).alias("_i", "path")).filter("path IS NOT NULL")
    there = each.join(listing.select("path"), "path", "left_semi")
    return there.groupBy(key).agg(F.min(F.struct("_i", "path")).alias("_m")).select(key, F.col("_m.path").alias("path"))


def resolve_images(df: DataFrame, key: str, image: str, listing: DataFrame, root: str) -> DataFrame:
    """df with resolved_path, NULL where no file is meant; every row stays. key is unique, listing(path) has distinct paths.

    In this order: the cell itself if absolute, root/cell, root/Images/cell, root/Images/name; then, if the name has a
    suffix, files of the same name with a download number ' (n)', in Images before root, the smallest name of several.
    Equi-joins only: the listing's names lose their number before they are compared.
    """
    cell = strip(F.col(image))
    given = df.select(key, F.when(cell != "", cell).alias("_c")).filter("_c IS NOT NULL")
    absolute = F.when(F.col("_c").startswith("/"), F.col("_c"))
    under = [F.concat(F.lit(f"{root}/{d}"), v) for d, v in (("", F.col("_c")), ("Images/", F.col("_c")), ("Images/", file_name(F.col("_c"))))]
    exact = _first_existing(given, key, [absolute, *under], listing)
    plain = F.regexp_replace(F.col("path"), NUMBERED, "$1")
    numbered = listing.select("path", F.lower(plain).alias("_k"))
    rest = given.join(exact, key, "left_anti").filter(file_suffix(F.col("_c")) != "")
    wanted = rest.select(key, F.posexplode(F.array(*[F.lower(F.concat(F.lit(f"{root}/{d}"), file_name(F.col("_c")))) for d in ("Images/", "")])).alias("_i", "_k"))
    near = wanted.join(numbered, "_k").groupBy(key).agg(F.min(F.struct("_i", "path")).alias("_m")).select(key, F.col("_m.path").alias("path"))
    return df.join(exact.unionByName(near).withColumnRenamed("path", "resolved_path"), key, "left")


def resolve_dataset_images(df: DataFrame, key: str, image: str, dataset: str, listing: DataFrame, root: str) -> DataFrame:
    """df with resolved_path by root/Images/<dataset>/name, root/cell, root/Images/cell; NULL if none exists, rows stay."""
    given = df.select(key, F.col(image).alias("_c"), F.col(dataset).alias("_d")).filter("_c IS NOT NULL AND _c <> ''")
    candidates = [F.concat(F.lit(f"{root}/Images/"), F.col("_d"), F.lit("/"), file_name(F.col("_c"))), F.concat(F.lit(f"{root}/"), F.col("_c")), F.concat(F.lit(f"{root}/Images/"), F.col("_c"))]
    found = _first_existing(given, key, candidates, listing)
    return df.join(found.withColumnRenamed("path", "resolved_path"), key, "left")
