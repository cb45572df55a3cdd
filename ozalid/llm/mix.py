"""Mixtures of sources with target shares of the total size.

Documents are counted by (source, exact size). A source whose need is above its own size is taken whole as often as
that goes; what remains is met by whole documents: of each size a number in proportion, and the last tokens by a
bounded-knapsack dynamic program over all sizes still open, which finds the sum nearest to the budget from below. Which
documents of a size are taken is decided by a seeded hash, with ranks that don't gather a hot size in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ozalid.operators.skew import salted_rank
from ozalid.session import cut_lineage

#: Tokens that the share of every size leaves to the dynamic program, if documents are smaller.
WINDOW = 1 << 16
#: Most additions of the dynamic program (steps x sums), some seconds of the driver's time, and the most sums, 5 bytes each.
MOST_WORK = 4_000_000_000
MOST_SUMS = 40_000_000
#: Most rows of a table of targets.
MOST_TARGETS = 100_000
#: Most different (source, size) pairs that the driver plans with, some 50 bytes each; only sources of a plan count, whose sizes are as many as there are different lengths.
MOST_CELLS = 2_000_000


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take (at most counts[size]) so that their sum is the largest at most budget.

    First a share of every size, in proportion to the budget less WINDOW; then the dynamic program over all sizes. Where
    that misses the budget, the program gets the whole budget if its bounds allow. The sum is the nearest one whenever the
    program gets the whole budget, and else whenever it is the budget itself.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    whole = sum(s * n for s, n in counts.items())
    if budget >= whole:
        return counts
    if budget <= 0:
        return {}
    part = max(0.0, (budget - WINDOW / 2) / whole)
    taken = {s: int(n * part) for s, n in counts.items()}
    left = budget - sum(s * n for s, n in taken.items())
    spare = {s: n - taken[s] for s, n in counts.items() if n > taken[s]}
    for s in sorted(spare, reverse=True):  # what rounding down left above the window
        if left <= WINDOW:
            break
        more = min(spare[s], (left - WINDOW // 2) // s)
        if more > 0:
            taken[s] += more
            spare[s] -= more
            left -= more * s
    rest = knapsack({s: n for s, n in spare.items() if n}, left)
    if part and sum(s * n for s, n in rest.items()) < left and _affordable(counts, budget):
        return knapsack(counts, budget)
    for s, n in rest.items():
        taken[s] += n
    return {s: n for s, n in taken.items() if n}


def _affordable(counts: dict[int, int], budget: int) -> bool:
    sums = budget // math.gcd(*counts)
    return sums <= MOST_SUMS and sums * sum(min(n, budget // s).bit_length() for s, n in counts.items()) <= MOST_WORK


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack: numbers of each size with the largest sum at most budget. Where the program would pass MOST_WORK
    or MOST_SUMS, the largest documents that fit come first."""
    out: dict[int, int] = {}
    fits = {s: n for s, n in counts.items() if s <= budget}
    while fits and not _affordable(fits, budget):
        s = max(fits)
        out[s] = min(fits.pop(s), budget // s)
        budget -= out[s] * s
        fits = {s: n for s, n in fits.items() if s <= budget}
    return out | (_fill(fits, budget) if fits else {})


def _fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """The dynamic program in units of the sizes' common divisor. Numbers are split into powers of two; of each sum the
    first step that reaches it is kept, so the way back takes every step at most once."""
    unit = math.gcd(*counts)
    budget //= unit
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    first = np.zeros(budget + 1, np.int32)
    steps: list[tuple[int, int]] = [(0, 0)]
    top = 0  # the largest sum reached
    for s in sorted(counts):
        n, k = min(counts[s], budget * unit // s), 1
        while n > 0 and not reach[budget]:
            k = min(k, n)
            w = s // unit * k
            upto = min(budget, top + w)
            new = reach[: upto - w + 1] & ~reach[w : upto + 1]
            if new.any():
                steps.append((s, k))
                first[w : upto + 1][new] = len(steps) - 1
                reach[w : upto + 1] |= new
                top = max(top, int(np.flatnonzero(reach[: upto + 1])[-1]))
            n -= k
            k *= 2
        if reach[budget]:
            break
    out: dict[int, int] = {}
    at = top
    while at:
        s, k = steps[first[at]]
        out[s] = out.get(s, 0) + k
        at -= s // unit * k
    return out


def mix_plan(cells: list[tuple[str, int, int]], targets: list[dict], total: int) -> tuple[list[dict], list[tuple]]:
    """(report rows, draws). cells: (source, size, documents) of the planned sources; total: tokens of all. A draw is (plan_id, source, size, whole uses, extra documents)."""
    by: dict[str, dict[int, int]] = {}
    for source, size, n in cells:
        by.setdefault(source, {})[size] = n
    own = {k: sum(s * n for s, n in v.items()) for k, v in by.items()}
    report, draws = [], []
    for t in targets:
        source, counts = t["source"], by.get(t["source"], {})
        need = t["target_share"] * (t["budget_factor"] * total)
        have = own.get(source, 0)
        wanted = min(int(need), t["max_repeats"] * have)
        uses = wanted // have if have else 0
        extra = fit(counts, wanted - uses * have)
        tokens = uses * have + sum(s * n for s, n in extra.items())
        draws += [(t["plan_id"], source, s, uses, extra.get(s, 0)) for s in counts if s > 0 and (uses or extra.get(s))]
        report.append(dict(t, own_documents=sum(counts.values()), own_tokens=have, needed_tokens=need, planned_tokens=tokens))
    return report, draws


def mixture(sized: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). sized: doc_id, source, n_tokens; targets: plan_id, source, target_share, max_repeats, budget_factor.

    mixture: plan_id, doc_id, source, n_tokens, uses (how often the document is used, at most max_repeats). report: a
    row per target: own_documents, own_tokens, needed_tokens, planned_tokens, drawn_tokens and documents (counted in the
    mixture), share (of the plan's drawn tokens) and short: all its documents are used as often as allowed and the mixture
    still holds less of it than needed, or it has none.
    Documents without tokens are never drawn, sources outside a plan add to the budget only (so do NULL ones).
    Repeated doc_ids count as documents of their own. No documents: an empty mixture, and every target is short.
    """
    spark = sized.sparkSession
    kept = cut_lineage(sized.select("doc_id", "source", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")))
    counted = kept.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    wanted = targets.filter("plan_id IS NOT NULL AND source IS NOT NULL").select("plan_id", "source", "target_share", "max_repeats", "budget_factor").orderBy("plan_id", "source").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    total = kept.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    named = spark.createDataFrame(sorted({(r["source"],) for r in wanted}), "source string")
    cells = counted.join(F.broadcast(named), "source", "left_semi").limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of planned source and size")
    report, draws = mix_plan([(r[0], r[1], r[2]) for r in cells], [r.asDict() for r in wanted], total)
    plan = spark.createDataFrame(draws, "plan_id string, source string, n_tokens long, whole int, extra long")
    part = kept.join(F.broadcast(plan.select("source").distinct()), "source", "left_semi")
    ranked = salted_rank(part.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))), ["source", "n_tokens"], [F.col("_h"), F.col("doc_id")]).drop("_h")
    # a row of ranked meets at most one row per plan
    met = ranked.join(plan, ["source", "n_tokens"])
    uses = F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    drawn = met.withColumn("uses", uses).filter("uses > 0").select("plan_id", "doc_id", "source", "n_tokens", "uses")
    shape = "plan_id string, source string, target_share double, max_repeats int, budget_factor double, own_documents long, own_tokens long, needed_tokens double, planned_tokens long"
    stated = spark.createDataFrame([tuple(r[c.split()[0]] for c in shape.split(", ")) for r in report], shape)
    got = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn_tokens"), F.count("*").alias("documents"))
    full = stated.join(got, ["plan_id", "source"], "left").fillna(0, ["drawn_tokens", "documents"])
    sums = full.groupBy("plan_id").agg(F.sum("drawn_tokens").alias("_all"))
    full = full.join(F.broadcast(sums), "plan_id").withColumn("share", F.when(F.col("_all") > 0, F.col("drawn_tokens") / F.col("_all"))).drop("_all")
    used_up = F.col("drawn_tokens") >= F.col("max_repeats") * F.col("own_tokens")
    full = full.withColumn("short", (F.col("own_documents") == 0) | (used_up & (F.col("drawn_tokens") < F.col("needed_tokens"))))
    return drawn, full
