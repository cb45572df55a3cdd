import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ozalid.llm.cutoff import LEVELS, Corpus, Vocabulary, chance, tokens, truncated, units, with_bare

PLACES = ["left lower lobe", "right upper lobe", "inner ear canal", "optic nerve head", "kidney cortex"]
THINGS = ["a fluid level", "mild oedema", "a thin rim of fluid", "focal atrophy", "loss of contrast"]


def sentence(rng):
    return rng.choice([f"There is {rng.choice(THINGS)} near the {rng.choice(PLACES)}.", f"Compared with the earlier study, {rng.choice(THINGS)} has become stable.", f"Slice thickness was {rng.random() * 9:.1f} mm with an overlap of {rng.random():.1f} mm.", f"Follow-up in {rng.randint(2, 60)} weeks is suggested for the {rng.choice(PLACES)}."])


def item(rng):
    return rng.choice([f"Check the {rng.choice(PLACES)} for {rng.choice(THINGS)}", f"Wait {rng.randint(1, 90)} seconds", f"Lower the gain until the {rng.choice(PLACES)} is dark"])


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if i % 3:
            texts.append(" ".join(sentence(rng) for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "\nEnd of report"]))
        else:
            texts.append("\n".join(f"- {item(rng)}" for _ in range(rng.randint(2, 8))))
    return rng, texts


@pytest.mark.parametrize(("text", "bare"), [("abc [...]", "abc"), ("abc (more)\n", "abc"), ("abc… (weiter)", "abc"), ("abc..", "abc"), ("abc.", "abc."), ("ab\ufffd", "ab"), ("[...]", ""), ("  ", ""), ("abc [end of item]", "abc [end of item]"), ("." * 100_000 + "x", "." * 100_000 + "x")])
def test_marks(spark, text, bare):
    assert with_bare(spark.createDataFrame([(text,)], "t string"), "t", "t").first()[0] == bare


@pytest.mark.parametrize(("text", "want"), [("A b 12.5 mm. C d?\n\n E  f", ["A b 0 mm.", "C d?\n", "E f"]), ("漢字。漢 字", ["漢字。", "漢 字"]), ("at 10:30, x47", ["at 0, x0"]), ("漢字？\n次", ["漢字？\n", "次"]), ("a.\tb\x01c\u2003 d", ["a.", "b c d"]), ("\n a", ["a"]), (" \u2003 ", []), (None, None)])
def test_units(spark, text, want):
    assert spark.range(1).select(units(F.lit(text).cast("string"))).first()[0] == want


def test_tokens():
    assert tokens("B-scan, 9.5 mm\n\nNimz47 漢字 don’t") == ["B", "-", "scan", ",", "0", "mm", "\n", "X0", "漢", "字", "don", "’", "t"]


def test_windows_of_equal_tails_are_equal():
    v = Vocabulary(["a", "b", "c", "."])
    c = Corpus([["a", "b", "c"], ["c", ".", "a", "b", "c"], []], v)
    at = np.flatnonzero(c.last)
    h = c.windows(at)
    assert h.shape == (LEVELS, 2) and (h[[0, 1, 2, 3, 4], 0] == h[[0, 1, 2, 3, 4], 1]).all() and h[6, 0] != h[6, 1]


def test_finds_cuts(spark):
    rng, texts = corpus(1, 1500)
    whole = {i: t for i, t in enumerate(texts)}
    cut = {}
    for i in range(0, 1500, 15):
        t = whole[i]
        at = rng.randint(len(t) // 2, len(t) - 4)
        while not (t[at - 1].isalpha() and t[at].isalpha()):
            at -= 1
        cut[i] = t[:at] + rng.choice(["", "…", " [...]", " "])
    rows = [(i, cut.get(i, t), "clash") for i, t in whole.items()] + [(9000 + i, cut[0], "clash") for i in range(700)] + [(8000, None, ""), (8001, "", ""), (8002, " \n", ""), (8003, "…", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string")
    got = {r["doc_id"] for r in truncated(df, "text", ["doc_id"]).collect()}
    want = set(cut) | {9000 + i for i in range(700)}
    assert len(got & want) / len(want) > 0.9 and len(got - want) <= 5


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "Some words [...]"), (3, "x" * 100_000), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in truncated(df, "text", ["doc_id"]).collect()} >= {2}
    assert truncated(df.limit(0), "text", ["doc_id"]).count() == 0


def test_near_copies_cut_at_one_place(spark):
    """A template cut between words in some hundred texts that differ in numbers and names: they don't vouch for each other."""
    rng, texts = corpus(2, 900)
    names = ["Meyer", "Okafor", "Lind", "Rossi", "Novak", "Tanaka"]
    cut = [f"Patient {rng.choice(names)} was seen on day {i}. Slice thickness was {i / 7:.1f} mm with an overlap" for i in range(300)]
    rows = [*enumerate(texts), *((5000 + i, t) for i, t in enumerate(cut))]
    got = {r["doc_id"] for r in truncated(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"]).collect()}
    assert {5000 + i for i in range(300)} <= got and len([i for i in got if i < 5000]) <= 5


def test_cases_are_prefixes_of_longer_copies(spark):
    """With evidence every case names a unit elsewhere that goes on where its tail stops."""
    rng, texts = corpus(3, 900)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, "Slice thickness was 3.1 mm. Follow-up in 7 weeks is sugg"), (5001, "There is mild oedema near the kidney cortex. Compared with the earlier study, mild oedema has"), (5002, "A b [...]")]
    got = {r["doc_id"]: r for r in truncated(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"], evidence=True).collect()}
    assert got[5000]["longer"].startswith("Follow-up in 0 weeks is suggested") and "has become stable" in got[5001]["longer"]
    assert got[5002]["longer"] is None and got[5001]["tail"] == "Compared with the earlier study, mild oedema has"
    assert [i for i in got if i < 5000] == []


def test_nothing_is_cut_without_longer_copies(spark):
    rows = [(i, f"Text {'abcdefghij'[i % 10]} stands alone") for i in range(200)]
    assert truncated(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"]).count() == 0


def test_equal_evidence_counts_once():
    assert chance([(4, 0), (4, 0), (4, 0)], 0.5) == chance([(4, 0)], 0.5) > chance([(4, 0), (3, 0)], 0.5)
