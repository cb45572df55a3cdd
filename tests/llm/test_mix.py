import itertools
import random

import pytest

from ozalid.llm.mix import fit, knapsack, mix_plan, mixture

PLAN = "plan_id string, source string, target_share double, max_repeats int, budget_factor double"


def brute(counts, budget):
    return max(s for s in (sum(a * b for a, b in zip(counts, n, strict=True)) for n in itertools.product(*[range(c + 1) for c in counts.values()])) if s <= budget)


@pytest.mark.parametrize("seed", range(20))
def test_knapsack_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = {rng.randint(2, 40): rng.randint(1, 4) for _ in range(5)}
    budget = rng.randint(0, 200)
    got = knapsack(counts, budget)
    assert all(n <= counts[s] for s, n in got.items()) and sum(s * n for s, n in got.items()) == brute(counts, budget)


@pytest.mark.parametrize("budget", [0, 1, 999, 123_457, 3_000_001, 10**9])
def test_fit_is_close(budget):
    counts = {s: 400 + s % 7 for s in range(3, 300, 3)} | {301: 50}
    got = fit(counts, budget)
    total = sum(s * n for s, n in counts.items())
    assert all(0 < n <= counts[s] for s, n in got.items())
    assert 0 <= min(budget, total) - sum(s * n for s, n in got.items()) <= (0 if budget >= 999 else 3)


def test_plan():
    report, draws = mix_plan([("a", 10, 10), ("a", 0, 3), ("b", 5, 2)], [dict(plan_id="p", source=s, target_share=t, max_repeats=m, budget_factor=1.0) for s, t, m in (("a", 0.75, 1), ("b", 0.1, 2), ("c", 0.1, 9))], 200)
    assert [(r["source"], r["own_documents"], r["planned_tokens"]) for r in report] == [("a", 13, 100), ("b", 2, 20), ("c", 0, 0)]
    assert ("p", "b", 5, 2, 0) in draws and not [d for d in draws if d[2] == 0]


def test_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 2}", 7 if i % 3 == 0 else 3 + i % 11, "clash") for i in range(900)] + [(1000, None, 5, ""), (1001, "s0", 0, ""), (1002, "s1", None, "")]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, uses string")
    targets = spark.createDataFrame([("p", "hot", 0.2, 1, 1.0), ("p", "s0", 0.5, 2, 1.0), ("p", "none", 0.3, 5, 1.0), ("q", "hot", 0.9, 4, 0.5)], PLAN)
    drawn, report = mixture(sized, targets, seed=1)
    rep = {(r["plan_id"], r["source"]): r for r in report.collect()}
    assert all(r["drawn_tokens"] == r["planned_tokens"] for r in rep.values()) and rep["p", "none"]["short"]
    assert abs(rep["p", "hot"]["drawn_tokens"] - rep["p", "hot"]["needed_tokens"]) <= 7
    got = drawn.collect()
    assert len({(r["plan_id"], r["doc_id"]) for r in got}) == len(got) and max(r["uses"] for r in got if r["plan_id"] == "p") <= 2
    assert {r["doc_id"] for r in got}.isdisjoint({1000, 1001, 1002})
    assert {tuple(r) for r in mixture(sized, targets, seed=1)[0].collect()} == {tuple(r) for r in got}


def test_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    drawn, report = mixture(sized, spark.createDataFrame([("p", "a", 0.5, 1, 1.0)], PLAN))
    assert drawn.count() == 0 and report.first()["short"]


def test_documents_above_the_window():
    assert fit({1_000_000: 3}, 2_010_000) == {1_000_000: 2}
    assert knapsack({400_000: 1, 300_000: 2}, 600_000) == {300_000: 2}


def test_all_sizes_where_some_do_not_reach():
    counts = {s: 1 for s in range(2000, 4000, 2)} | {3331: 1}
    assert sum(s * n for s, n in knapsack(counts, 3331).items()) == 3331


def test_large_documents_reach_the_budget():
    assert fit({700_000: 1, 500_000: 3}, 1_500_000) == {500_000: 3}
    assert fit({300_000: 4, 700_001: 2}, 1_400_002) == {700_001: 2}


def test_many_sizes_reach_the_budget():
    counts = {2 * s: 1 for s in range(5000, 6000)} | {30_001: 1}
    assert sum(s * n for s, n in fit(counts, 30_001).items()) == 30_001


def test_short_is_read_from_the_mixture(spark):
    sized = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aaaabbbbbbcc")], "doc_id long, source string, n_tokens int")
    rows = [("p", "a", 0.7, 2, 1.0), ("p", "b", 0.5, 1, 1.0), ("p", "c", 2.5 / 12, 1, 1.0), ("p", "d", 0.0, 1, 1.0)]
    got = {r["source"]: (r["drawn_tokens"], r["short"]) for r in mixture(sized, spark.createDataFrame(rows, PLAN))[1].collect()}
    assert got == {"a": (80, True), "b": (60, False), "c": (20, True), "d": (0, True)}
