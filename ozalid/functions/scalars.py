"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")


def strip(text: Column) -> Column:
    """text without any white space at its ends, line breaks and Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def half_even(x: Column) -> Column:
    """The nearest integer; a half goes to the even one."""
    return F.rint(x).cast("int")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def truncate(x: Column) -> Column:
    """x without its fraction, as INT."""
    return x.cast("int")


def seeded_hash(seed: int | str, key: Column) -> Column:
    """A portable hash to order by: md5 of seed|key, the same text in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def file_stem(path: Column) -> Column:
    """The name without its last suffix; .nii.gz counts as one."""
    return F.regexp_replace(file_name(path), r"(?i)(\.nii\.gz|\.[^.]+)$", "")


def file_suffix(path: Column) -> Column:
    """The lower-case suffix with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?i)(\.nii\.gz|\.[^.]+)$", 1))


def seconds_text(seconds: Column) -> Column:
    """seconds with four decimals, rounded by the exact binary value as C and Python do, not by its shortest writing.

    The two differ where the writing ends in a 5 on the fifth decimal. There 20000 * seconds is next to an odd
    number, and the exact product (its rounding error from a split of the factor) says on which side the value lies.
    """
    p = seconds * 20000.0
    odd = F.rint(p)
    c = seconds * 134217729.0
    high = c - (c - seconds)
    side = (p - odd) + ((high * 20000.0 - p) + (seconds - high) * 20000.0)
    below = F.floor(odd / 2)
    even = F.when(below % 2 == 0, below).otherwise(below + 1)
    chosen = F.when(side < 0, below).when(side > 0, below + 1).otherwise(even) / 10000.0
    tie = (F.abs(p - odd) < 1e-6) & (F.abs(p) < 2.0**40) & (F.pmod(odd, F.lit(2.0)) == 1.0)
    return F.when(seconds.isNotNull(), F.format_string("%.4f", F.when(tie, chosen).otherwise(seconds)))


def python_bool(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
