"""Samples that match target proportions of categories: the cube method on category indicators.

Every record starts with the inclusion probability draw / available of its category, kept as an integer numerator. A
flight phase moves two open records of one category along the kernel of the indicator constraints (what one gains the
other loses) until one of them is decided, so each category's sum is kept exactly. As a plan samples by one field, its
indicators don't overlap and every kernel vector has this form. Flights run in every partition at once; a partition leaves at most one open record per plan and category. These merge upward, FAN_IN partitions into one,
and fly again; landing decides what is open at the end. As numerators are integers and sums of draws whole, the residual
imbalance after landing is 0 unless a plan asks for fractions, and the report states it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ozalid.session import cut_lineage

FAN_IN = 32
#: Most rows of a table of targets: it is gathered by the driver and broadcast, some 200 bytes a row.
MOST_TARGETS = 100_000
_SHAPE = "plan_id string, category string, key string, h long, num long, den long, part int"


def needs(plan: list[dict], rows: int) -> list[dict]:
    """Adds size, needed, draw and gave_way to the rows of one plan (target_share, min_rows, sample_fraction, available).

    needed is the larger of ceil(target_share * size) and min_rows, in doubles. Where fewer rows are there, all are
    drawn. If the draws exceed the size, categories furthest above their exact share give way down to min_rows; if they
    fall below it, listed categories with spare rows take more in proportion to their share.
    """
    size = math.floor(plan[0]["sample_fraction"] * rows)
    out = [dict(r, size=size, needed=max(math.ceil(r["target_share"] * size), r["min_rows"])) for r in plan]
    for r in out:
        r["draw"] = min(r["needed"], r["available"])
    over = sum(r["draw"] for r in out) - size
    while over > 0:
        able = [r for r in out if r["draw"] > min(r["min_rows"], r["available"])]
        if not able:
            break  # the minimums alone exceed the size: they stay
        top = max(able, key=lambda r: (r["draw"] - r["target_share"] * size, r["category"]))
        step = max(1, min(over, int(top["draw"] - top["target_share"] * size)))
        step = min(step, top["draw"] - min(top["min_rows"], top["available"]))
        top["draw"] -= step
        over -= step
    left = -over
    while left > 0:
        able = [r for r in out if r["available"] > r["draw"] and r["target_share"] > 0]
        whole = sum(r["target_share"] for r in able)
        if not able:
            break  # nothing is left to draw: the sample stays smaller
        given = 0
        for r in sorted(able, key=lambda r: (-r["target_share"], r["category"])):
            more = min(r["available"] - r["draw"], max(1, int(left * r["target_share"] / whole)), left - given)
            r["draw"] += more
            given += more
        left -= given
    for r in out:
        r["gave_way"] = max(0, min(r["needed"], r["available"]) - r["draw"])
    return out


def _uniform(h: int, salt: int) -> float:
    x = (h * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = (x * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) >> 11) / 2.0**53


def flight(open_one: tuple[str, int, int] | None, new: tuple[str, int, int], den: int, salt: int) -> tuple[tuple[str, int, int] | None, list[str]]:
    """One move of (key, hash, numerator) pairs: the record still open, if any, and the keys decided to be drawn."""
    if new[2] >= den:
        return open_one, [new[0]]
    if new[2] <= 0:
        return open_one, []
    if open_one is None:
        return new, []
    (a, ha, x), (b, hb, y) = open_one, new
    u = _uniform(ha ^ (hb >> 1), salt)
    both = x + y
    if both <= den:  # one of them falls to 0, the other takes the sum
        key, h = (a, ha) if u * both < x else (b, hb)
        return (None, [key]) if both == den else ((key, h, both), [])
    rest = both - den  # one of them rises to 1, the other keeps the rest
    if u * (2 * den - both) < den - y:
        return (b, hb, rest), [a]
    return (a, ha, rest), [b]


def _fly(salt: int, land: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        waiting: dict[tuple[str, str], tuple[tuple[str, int, int], int]] = {}
        for pdf in batches:
            drawn = []
            for plan, category, key, h, num, den in zip(pdf["plan_id"].array, pdf["category"].array, pdf["key"].array, pdf["h"].to_numpy(), pdf["num"].to_numpy(), pdf["den"].to_numpy(), strict=True):
                cell = (plan, category)
                held = waiting.get(cell)
                still, keys = flight(held and held[0], (key, int(h), int(num)), int(den), salt)
                if still is None:
                    waiting.pop(cell, None)
                else:
                    waiting[cell] = (still, int(den))
                drawn += [(plan, category, k, 0, 1, 1, part) for k in keys]
            if drawn:
                yield pd.DataFrame(drawn, columns=["plan_id", "category", "key", "h", "num", "den", "part"])
        rest = [(plan, category, k, h, num, den, part) for (plan, category), ((k, h, num), den) in waiting.items()]
        if land:
            rest = [(p, c, k, 0, 1, 1, part) for p, c, k, h, num, den, part in rest if _uniform(h, salt + 1) * den < num]
        if rest:
            yield pd.DataFrame(rest, columns=["plan_id", "category", "key", "h", "num", "den", "part"])

    return run


def allocate(members: DataFrame, targets: DataFrame, rows: int) -> list[dict]:
    """The rows of targets with available, size, needed, draw and gave_way. members: plan_id, category, key, distinct."""
    wanted = targets.select("plan_id", "field", "category", "target_share", "min_rows", "sample_fraction").filter("plan_id IS NOT NULL AND category IS NOT NULL AND target_share IS NOT NULL")
    wanted = wanted.withColumn("min_rows", F.coalesce("min_rows", F.lit(0)))
    names = wanted.select("plan_id", "category").distinct()
    counts = members.join(names, ["plan_id", "category"], "left_semi").groupBy("plan_id", "category").agg(F.count("*").alias("available"))
    got = wanted.join(counts, ["plan_id", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0))).orderBy("plan_id", "category").limit(MOST_TARGETS + 1).collect()
    if len(got) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    plans: dict[str, list[dict]] = {}
    for r in got:
        plans.setdefault(r["plan_id"], []).append(r.asDict())
    return [r for plan in plans.values() for r in needs(plan, rows)]


def cube_sample(members: DataFrame, targets: DataFrame, rows: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan of targets.

    members: plan_id, category, key; each key once per plan, keys not NULL; NULL categories are never drawn. rows: the
    number N of distinct keys that sample_fraction applies to. sample: plan_id, category, key. report: a row per target
    with size, needed, available, draw, gave_way (rows it left to other categories), drawn (counted in the sample),
    residual (drawn - draw) and short: what was drawn and what it left to others is less than it needed. Empty members:
    an empty sample and a report in which every category that needs rows is short.
    """
    spark = members.sparkSession
    plan = allocate(members, targets, rows)
    cells = spark.createDataFrame([(r["plan_id"], r["category"], r["draw"], r["available"]) for r in plan if r["draw"] > 0], "plan_id string, category string, num long, den long")
    start = members.select("plan_id", "category", "key").join(F.broadcast(cells), ["plan_id", "category"])
    hashed = start.select("plan_id", "category", "key", F.xxhash64("key", "plan_id", F.lit(seed)).alias("h"), "num", "den", F.lit(0).alias("part"))
    # fixed contents and order of each partition: a task that runs again decides the same
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    even = hashed.repartition(parts, "h").sortWithinPartitions("plan_id", "category", "h", "key")
    flown = cut_lineage(even.mapInPandas(_fly(seed, parts == 1), _SHAPE))
    done = [flown.filter("num = den")]
    level = 0
    while parts > 1:
        level += 1
        parts = -(-parts // FAN_IN)
        rest = flown.filter("num < den").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = rest.repartitionByRange(parts, "part") if parts > 1 else rest.coalesce(1)
        flown = cut_lineage(merged.sortWithinPartitions("plan_id", "category", "h", "key").mapInPandas(_fly(seed + level, parts == 1), _SHAPE))
        done.append(flown.filter("num = den"))
    sample = done[0]
    for more in done[1:]:
        sample = sample.unionByName(more)
    sample = sample.select("plan_id", "category", "key")
    shape = "plan_id string, field string, category string, target_share double, min_rows long, size long, needed long, available long, draw long, gave_way long"
    stated = spark.createDataFrame([tuple(r[c.split()[0]] for c in shape.split(", ")) for r in plan], shape)
    drawn = sample.groupBy("plan_id", "category").agg(F.count("*").alias("drawn"))
    report = stated.join(drawn, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("residual", F.col("drawn") - F.col("draw"))
    report = report.withColumn("short", F.col("drawn") + F.col("gave_way") < F.col("needed"))
    return sample, report
