"""Percentiles of very large numeric columns by radix selection.

A double maps to a signed 64-bit key of the same order. Round i counts the i-th 16-bit digit of the keys per group,
only over keys that share the digits found before, and follows the one digit that contains each target rank. Each
round is one scan with a partial count before a small shuffle: what moves grows with groups x occupied digits, not
with rows. Counts of separate pieces (days, shards) add up, so pieces can be counted apart and combined later.

After `rounds` rounds the relative error of a percentile of magnitude above 2**-1022 is below 2**(12 - 16 * rounds);
after four it is exactly 0, the value is one of the column (nearest rank: the ceil(p * n)-th smallest).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage

DIGIT_BITS = 16
ROUNDS = 4
#: Targets (groups x percentiles) up to this many are broadcast, each some 100 bytes; beyond, only those of hot groups.
MOST_BROADCAST_TARGETS = 50_000
PERCENTILES = ("0.5", "0.9", "0.99", "0.999")


def with_number(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the double written in df[text]: NULL where it isn't a decimal number, nan or an infinity."""
    cast = df.withColumn("_c", F.col(text).try_cast("double"))
    java_only = F.translate(F.col(text), "dDfFxXpP", "") != F.col(text)  # suffixes and hexadecimal forms
    special = F.isnan("_c") | (F.abs("_c") == F.lit(float("inf")))
    return cast.withColumn(out, F.when(special | ~java_only, F.col("_c"))).drop("_c")


def with_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with `out`, a signed 64-bit integer of the same order as the finite double df[value]: its IEEE bits, mirrored
    below zero. Exact arithmetic with powers of two, in steps that are each computed once inside generated code."""
    x = F.col("_x")
    sized = df.withColumn("_x", F.when(~F.isnan(value) & (F.abs(F.col(value)) < F.lit(float("inf"))), F.abs(F.col(value))))
    guess = sized.withColumn("_g", F.when(x > 0, F.least(F.lit(1023), F.floor(F.log2(x)).cast("int"))))
    one = F.lit(1).cast("long")
    small = F.when(F.col("_g") >= 0, F.call_function("shiftleft", one, F.col("_g")).cast("double")).otherwise(1.0 / F.call_function("shiftleft", one, -F.col("_g")).cast("double"))
    power = guess.withColumn("_p", F.when(F.col("_g").between(-62, 62), small).otherwise(F.pow(F.lit(2.0), F.col("_g"))))
    off = F.when(x < F.col("_p"), -1).when(x >= F.col("_p") * 2.0, 1).otherwise(0)  # log2 may be off by one near a power
    exact = power.withColumn("_o", off)
    mantissa = ((x / F.col("_p") / F.when(F.col("_o") == 0, 1.0).when(F.col("_o") > 0, 2.0).otherwise(0.5) - 1.0) * F.lit(2.0**52)).cast("long")
    normal = (F.col("_g") + F.col("_o") + 1023).cast("long") * F.lit(2**52) + mantissa
    subnormal = (x * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = exact.withColumn("_b", F.when(x == 0.0, F.lit(0).cast("long")).when(x < F.lit(2.0**-1022), subnormal).otherwise(normal))
    return bits.withColumn(out, F.when(F.col(value) < 0, -F.col("_b") - 1).otherwise(F.col("_b"))).drop("_x", "_g", "_p", "_o", "_b")


def key_value(key: Column) -> Column:
    """The double of an order_key."""
    bits = F.when(key < 0, -(key + 1)).otherwise(key)
    e = F.shiftright(bits, 52)
    m = bits.bitwiseAND(F.lit(2**52 - 1)).cast("double")
    size = F.when(e == 0, m / F.lit(2.0**537) / F.lit(2.0**537)).otherwise((1.0 + m / F.lit(2.0**52)) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(key < 0, -size).otherwise(size)


def classify(value: Column, raw_missing: Column | None = None) -> Column:
    """ok, missing, unreadable, nan, infinite or negative; only ok values enter percentiles."""
    missing = value.isNull() if raw_missing is None else raw_missing
    return (
        F.when(missing, "missing").when(value.isNull(), "unreadable").when(F.isnan(value), "nan")
        .when(F.abs(value) == F.lit(float("inf")), "infinite").when(value < 0, "negative").otherwise("ok")
    )


def _digit(key: Column, round_no: int) -> Column:
    moved = F.shiftright(key, 64 - DIGIT_BITS * round_no)
    return (moved if round_no == 1 else moved.bitwiseAND(F.lit(2**DIGIT_BITS - 1))).cast("int")


def digit_counts(df: DataFrame, by: list[str], value: str, status: str, bits: int = DIGIT_BITS) -> DataFrame:
    """The mergeable piece: rows per (by..., status, first `bits` bits of the key); prefix is NULL unless status is ok."""
    prefix = F.when(F.col(status) == "ok", F.shiftright("_k", 64 - bits))
    return with_key(df, value, "_k").groupBy(*by, F.col(status).alias("status"), prefix.alias("prefix")).agg(F.count("*").alias("n"))


def merge_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of many pieces as those of one."""
    return counts.groupBy(*by, "status", "prefix").agg(F.sum("n").alias("n"))


def _targets(first: DataFrame, by: list[str], percentiles: tuple[str, ...]) -> DataFrame:
    """One row per group and percentile with its 1-based rank by exact fractions; groups without ok values stay, rank NULL."""
    statuses = ("missing", "unreadable", "nan", "infinite", "negative")
    totals = first.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n"))), F.lit(0)).alias("n_valid"),
        *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in statuses],
    )
    wanted = [Fraction(p) for p in percentiles]
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.lit(w.numerator).cast("long").alias("num"), F.lit(w.denominator).cast("long").alias("den")) for p, w in zip(percentiles, wanted, strict=True)]))
    rank = F.greatest(F.lit(1), F.expr("(num * n_valid + den - 1) div den"))
    return totals.select("*", each.alias("_p")).select(*totals.columns, "_p.*").withColumn("rank", F.when(F.col("n_valid") > 0, rank)).drop("num", "den")


def _same(left: str, right: str, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _follow(targets: DataFrame, counts: DataFrame, by: list[str], round_no: int) -> DataFrame:
    """Targets with the digit that contains their rank appended to prefix and the rank within it."""
    keys = by if round_no == 1 else [*by, "prefix"]
    running = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(running)).withColumn("below", F.col("upto") - F.col("n"))
    hit = _same("t", "c", keys) & (F.col("t.rank") > F.col("c.below")) & (F.col("t.rank") <= F.col("c.upto"))
    joined = targets.alias("t").join(upto.alias("c"), hit, "left")
    kept = [F.col(f"t.{c}") for c in targets.columns if c not in ("prefix", "rank")]
    prefix = F.col("c.digit").cast("long") if round_no == 1 else F.col("t.prefix") * F.lit(2**DIGIT_BITS) + F.col("c.digit")
    return joined.select(*kept, prefix.alias("prefix"), (F.col("t.rank") - F.col("c.below")).alias("rank"))


def _known(targets: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The targets as a table read from the driver where they are few; else cut by a checkpoint, for a shuffle join."""
    rows = targets.limit(most + 1).collect()
    if len(rows) <= most:
        return targets.sparkSession.createDataFrame(rows, targets.schema), True
    return cut_lineage(targets), False


def _with_targets(valid: DataFrame, wanted: DataFrame, by: list[str], few: bool) -> DataFrame:
    """valid (by..., _v) with the columns of wanted (by..., n_valid, _r...). Few targets are broadcast, else those of hot groups are."""
    ranges = [c for c in wanted.columns if c.startswith("_r")]
    if few:
        return valid.alias("k").join(F.broadcast(wanted).alias("w"), _same("k", "w", by)).select(*[F.col(f"k.{c}") for c in by], "_v", *ranges)
    named = wanted.select(F.xxhash64(F.struct(*by)).alias("_g"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in wanted.columns if c not in by])
    total = wanted.agg(F.coalesce(F.sum("n_valid"), F.lit(0))).first()[0]
    met = join_by_share(valid.withColumn("_g", F.xxhash64(F.struct(*by))), named, "_g", "n_valid", total)
    for i, c in enumerate(by):  # groups of one hash
        met = met.filter(F.col(c).eqNullSafe(F.col(f"_by{i}")))
    return met.select(*by, "_v", *ranges)


def percentiles(df: DataFrame, by: list[str], value: str, status: str, at: tuple[str, ...] = PERCENTILES, rounds: int = ROUNDS, pieces: list[str] | None = None, most_broadcast: int = MOST_BROADCAST_TARGETS) -> DataFrame:
    """Percentiles `at` of df[value] per group, over rows whose df[status] is ok; others are counted apart.

    Result: by..., percentile, value, max_relative_error, n_valid, n_missing, n_unreadable, n_nan, n_infinite, n_negative.
    A NULL group is a group. A group without valid values gets a NULL value. An empty table gives an empty result.
    Ties need no rule: equal values share a key. Columns of df besides by, value, status and pieces are never read.
    pieces: columns of the first count's pieces (day, shard); the counts are made per piece and then added up.
    """
    if not 1 <= rounds <= ROUNDS:
        raise ValueError("rounds must be 1 to 4")
    narrow = df.select(*by, *(pieces or []), F.col(value).alias("_v"), F.col(status).alias("_s"))
    first = digit_counts(narrow, [*by, *(pieces or [])], "_v", "_s")
    if pieces:
        first = merge_counts(first, by)
    first = cut_lineage(first)  # groups x occupied digits; read twice
    targets = _targets(first, by, at).withColumn("prefix", F.lit(None).cast("long"))
    counts = first.filter("status = 'ok'").select(*by, F.col("prefix").cast("int").alias("digit"), "n")
    targets, few = _known(_follow(targets, counts, by, 1), most_broadcast)
    valid = narrow.filter(F.col("_s") == "ok").select(*by, "_v")
    for round_no in range(2, rounds + 1):
        unit = 2 ** (64 - DIGIT_BITS * (round_no - 1))
        ranges = F.struct(key_value(F.col("prefix") * F.lit(unit)).alias("lo"), key_value((F.col("prefix") + 1) * F.lit(unit)).alias("hi"))
        wanted = targets.filter("prefix IS NOT NULL").groupBy(*by).agg(F.max("n_valid").alias("n_valid"), F.collect_set(ranges).alias("r"))
        wanted = wanted.select(*by, "n_valid", *[F.get("r", F.lit(i)).alias(f"_r{i}") for i in range(len(at))])
        inside = F.lit(False)
        for i in range(len(at)):
            inside = inside | F.coalesce((F.col("_v") >= F.col(f"_r{i}.lo")) & (F.col("_v") < F.col(f"_r{i}.hi")), F.lit(False))
        joined = _with_targets(valid, wanted, by, few).filter(inside)
        keyed = with_key(joined.select(*by, "_v"), "_v", "_k")
        prefix = F.shiftright("_k", 64 - DIGIT_BITS * (round_no - 1))
        counts = keyed.groupBy(*by, prefix.alias("prefix"), _digit(F.col("_k"), round_no).alias("digit")).agg(F.count("*").alias("n"))
        targets, few = _known(_follow(targets, counts, by, round_no), most_broadcast)
    low = key_value(F.col("prefix") * F.lit(2 ** (64 - DIGIT_BITS * rounds)))
    error = F.lit(0.0 if rounds == ROUNDS else 2.0 ** (12 - DIGIT_BITS * rounds))
    shown = [c for c in targets.columns if c.startswith("n_")]
    return targets.select(*by, "percentile", low.alias("value"), error.alias("max_relative_error"), *shown)


def percentiles_of_counts(counts: DataFrame, by: list[str], bits: int, at: tuple[str, ...] = PERCENTILES) -> DataFrame:
    """Percentiles from stored digit_counts of any pieces, without the rows: exact rank, value known to its prefix.

    value is the lower bound of the prefix, upper the bound above; upper / value - 1 is below max_relative_error.
    """
    merged = merge_counts(counts, by)
    targets = _targets(merged, by, at).withColumn("prefix", F.lit(None).cast("long"))
    cells = merged.filter("status = 'ok'").select(*by, "prefix", "n")
    running = Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("upto", F.sum("n").over(running)).withColumn("below", F.col("upto") - F.col("n"))
    hit = _same("t", "c", by) & (F.col("t.rank") > F.col("c.below")) & (F.col("t.rank") <= F.col("c.upto"))
    unit = 2 ** (64 - bits)
    shown = [F.col(f"t.{c}") for c in targets.columns if c.startswith("n_")]
    return targets.alias("t").join(upto.alias("c"), hit, "left").select(
        *[F.col(f"t.{c}") for c in by], F.col("t.percentile"), key_value(F.col("c.prefix") * F.lit(unit)).alias("value"),
        key_value((F.col("c.prefix") + 1) * F.lit(unit)).alias("upper"), F.lit(2.0 ** (12 - bits)).alias("max_relative_error"), *shown,
    )
