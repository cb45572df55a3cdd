"""Splits that keep related records together.

Linked keys are joined by distributed union-find: each partition keeps a forest of its own edges, forests are merged
level by level (FAN_IN partitions into one), and each merge drops every edge inside a tree. Edges are dealt out by both
their ends, so a hub's are spread; forests merge by the number of their partition, whatever keys they hold. A merge never
takes more than MERGE_ROWS edges into one task, the largest task counted: where a level would, the rest is contracted by
large-star and small-star joins, split for hubs, which need no bound. Groups then go to splits greedily, largest first, each to the split furthest below its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.operators.skew import join_by_share, salted_rank
from ozalid.session import cut_lineage

FAN_IN = 8
#: Most splits, all of which the driver plans with.
MOST_SPLITS = 1000
#: Most edges in one task, some 200 bytes each while they are merged.
MERGE_ROWS = 1_000_000


_EDGES = "a string, b string, part int"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition: (node, smallest node of its tree, this partition), roots left out."""
    context = TaskContext.get()
    number = context.partitionId() if context else 0
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].array, pdf["b"].array, strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:  # the smaller one stays root; path compression keeps trees flat
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = [(n, r) for n in nodes[i : i + 100_000] if (r := find(n)) != n]
        yield pd.DataFrame(part, columns=["a", "b"], dtype=object).assign(part=np.int32(number))


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the least node m that their a sees; least: a, m, rows (edges with this a)."""
    return join_by_share(edges, least, "a", "rows", edges.count())


def _star_round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: every node is tied to the least node that it sees; hubs only meet their minimum."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    up = F.sum(F.when(F.col("b") > F.col("a"), 1).otherwise(0)).alias("rows")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), up)
    large = _to_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = cut_lineage(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
    small = _to_least(down, least)
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m"))).filter("a <> b").distinct()


def connected(edges: DataFrame, a: str, b: str, partitions: int | None = None, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(node, root): the smallest key of each node's component, for every node of an edge.

    Edges with a NULL side or both sides the same, repeated and reversed edges change nothing. No edges: no rows.
    """
    spark = edges.sparkSession
    parts = partitions or max(1, min(256, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    apart = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    clean = edges.filter(apart).select(F.least(a, b).cast("string").alias("a"), F.greatest(a, b).cast("string").alias("b"))
    forest = cut_lineage(clean.repartition(parts, "a", "b").mapInPandas(_forest, _EDGES))
    while parts > 1:
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        largest = forest.groupBy(group.alias("g")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if largest > merge_rows:
            break
        parts = -(-parts // FAN_IN)
        forest = cut_lineage(forest.repartitionById(parts, group).mapInPandas(_forest, _EDGES))
    forest = forest.select("a", "b")
    if parts > 1:
        while True:
            last, forest = forest, cut_lineage(_star_round(forest))
            if forest.count() == last.count() and forest.join(last, ["a", "b"], "left_anti").isEmpty():
                break
    return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(forest.select("b", "b").distinct())


# -- cases -----------------------------------------------------------------------------------------------------------

CASE = r"^\W*([A-Za-z]+?)(?:_(?:train|eval))?[^A-Za-z0-9]*0*([0-9]+)"


def case_key(text: Column, catalog: list[tuple[str, str]]) -> Column:
    """family and number of a case or question id as 'code:number'; NULL where none can be read.

    catalog: (family, code) rows of dataset_catalog, a fixed table. Names outside it stand for themselves.
    """
    name = F.lower(F.regexp_extract(text, CASE, 1))
    codes = F.create_map(*[F.lit(x) for family, code in catalog for x in (family.lower(), code.lower())]) if catalog else None
    known = F.coalesce(F.element_at(codes, name), name) if catalog else name
    number = F.regexp_extract(text, CASE, 2)
    return F.when(number != "", F.concat_ws(":", known, number))


def read_catalog(spark: SparkSession, sf_dir: str, most: int = 10_000) -> list[tuple[str, str]]:
    rows = spark.read.parquet(f"{sf_dir}/dataset_catalog.parquet").select("family", "code").filter("family IS NOT NULL AND code IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("dataset_catalog is a fixed table of few rows")
    return sorted((r[0], r[1]) for r in rows)


def grouped_items(items: DataFrame, links: DataFrame, catalog: list[tuple[str, str]], merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(question_id, group_id, group_rows) of each distinct question_id; group_id is the smallest id of the group.

    items needs question_id; repeated ids count once, NULL ids are left out, an id without a readable case is a group
    of its own. links needs case_a, case_b. Extra columns are not read.
    """
    ids = items.select("question_id").filter("question_id IS NOT NULL").distinct()
    cased = ids.withColumn("case_id", F.coalesce(case_key(F.col("question_id"), catalog), F.concat(F.lit("id="), "question_id")))
    pairs = links.select(case_key(F.col("case_a"), catalog).alias("ka"), case_key(F.col("case_b"), catalog).alias("kb"))
    roots = connected(pairs, "ka", "kb", merge_rows=merge_rows)
    cases = cased.groupBy("case_id").agg(F.count("*").alias("rows"), F.min("question_id").alias("least"))
    joined = cases.join(roots.withColumnRenamed("node", "case_id"), "case_id", "left").withColumn("root", F.coalesce("root", "case_id"))
    joined = cut_lineage(joined)
    groups = joined.groupBy("root").agg(F.sum("rows").alias("group_rows"), F.min("least").alias("group_id"))
    sizes = joined.groupBy("root").agg(F.count("*").alias("cases")).join(groups, "root")
    table = join_by_share(joined.select("root", "case_id", "rows"), sizes, "root", "cases", joined.count()).select("case_id", "rows", "group_rows", "group_id")
    total = joined.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_by_share(cased, table, "case_id", "rows", total).select("question_id", "group_id", "group_rows")


# -- assignment ------------------------------------------------------------------------------------------------------


def plan_sizes(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """How many groups of each size go to each split, largest first, each to the split furthest below its target.

    sizes: (group size, number of groups); there are at most sqrt(2 x rows) different sizes. Groups of one size are
    placed in runs while the same split stays furthest below, so the work doesn't grow with the number of groups.
    """
    total = sum(s * n for s, n in sizes)
    whole = sum(shares.values()) or 1.0
    lack = {k: total * v / whole for k, v in shares.items()}
    names = sorted(shares)
    out: dict[int, dict[str, int]] = {}
    for size, count in sorted(sizes, reverse=True):
        got = dict.fromkeys(names, 0)
        left = count
        while left:
            # furthest below its target first, ties by name; a run lasts until the next split lacks more
            first, *rest = heapq.nsmallest(2, names, key=lambda k: (-lack[k], k))
            gap = lack[first] - lack[rest[0]] if rest else float("inf")
            run = left if not rest else max(1, min(left, int(gap // size)))
            if rest and run == 1 and left > 4 * len(names) and lack[first] - min(lack.values()) <= size:
                even = left // len(names) - 1  # all are level: a whole round leaves them level
                for k in names:
                    got[k] += even
                    lack[k] -= even * size
                left -= even * len(names)
                continue
            got[first] += run
            lack[first] -= run * size
            left -= run
        out[size] = {k: v for k, v in got.items() if v}
    return out


def assign_splits(items: DataFrame, links: DataFrame, targets: DataFrame, catalog: list[tuple[str, str]], seed: int = 0) -> DataFrame:
    """(question_id, group_id, split): whole groups, shares as near to targets (split, target_share) as groups allow."""
    given = targets.select("split", "target_share").filter("split IS NOT NULL AND target_share > 0").limit(MOST_SPLITS + 1).collect()
    if len(given) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares = {r[0]: float(r[1]) for r in given}
    if not shares:
        raise ValueError("no split has a positive target_share")
    rows = cut_lineage(grouped_items(items, links, catalog))
    groups = rows.groupBy("group_id").agg(F.count("*").alias("size"))
    sizes = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    plan = plan_sizes(sizes, shares)
    steps = []
    for size, got in plan.items():
        at = 0
        for k in sorted(got):
            steps.append((size, at, at + got[k], k))
            at += got[k]
    spark = items.sparkSession
    # at most one row per size and split; there are at most sqrt(2 x rows) sizes
    table = spark.createDataFrame(steps, "size long, lo long, hi long, split string")
    ranked = salted_rank(groups.withColumn("_h", F.xxhash64("group_id", F.lit(seed))), ["size"], [F.col("_h"), F.col("group_id")])
    bounds = table.groupBy("size").agg(F.collect_list(F.struct("lo", "hi", "split")).alias("bounds"))
    bounds = bounds.join(spark.createDataFrame(sizes, "size long, groups long"), "size")
    met = join_by_share(ranked, bounds, "size", "groups", sum(n for _, n in sizes))
    split = F.filter("bounds", lambda x: (F.col("rank") > x["lo"]) & (F.col("rank") <= x["hi"]))[0]["split"]
    placed = met.select("group_id", split.alias("split"), F.col("size").alias("rows"))
    total = sum(s * n for s, n in sizes)
    return join_by_share(rows.select("question_id", "group_id"), placed, "group_id", "rows", total).select("question_id", "group_id", "split")
