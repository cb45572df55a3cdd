import pytest

from ozalid.llm.canonical import Dictionary, deletions, map_values, use_counts
from ozalid.llm.textfold import fold, typing_distance

TERMS = [(1, "Computed tomography", "CT"), (2, "Pleural effusion", None), (3, "Optic nerve head", "ONH"), (4, "Magnetic resonance imaging", "MRI"), (5, "Lung consolidation", None), (6, "No involvement", None), (7, "Renal cyst", None)]


@pytest.mark.parametrize(
    ("value", "term"),
    [("computed  tomografy", 1), ("tomography, computed", 1), ("Computedtomography", 1), ("C0mputed t0m0graphy", 1), ("Ｃｏｍｐｕｔｅｄ　ｔｏｍｏｇｒａｐｈｙ", 1), ("Cоmputеd tomography", 1), (" CT ", 1), ("c.t.", 1), ("CT (abbr.)", 1), ("CT: computed tomography", 1), ("magnetic resonance image", 4), ("Magnetic re\xadsonance imaging", 4), ("probable pleural effusion, cannot exclude other", 2), ("pleural effusions", 2), ("head Optic nerve", 3), ("Lung c0ns01idati0n", 5), ("N0 inv01vement", 6),
     ("Pleural plaque", 0), ("Renal stone fragment", 0), ("12 mm", 0), ("-", 0), ("???", 0), ("n/a", 0), ("both of the above", 0), ("Hip prosthesis", 0), ("x" * 10000, 0)],
)
def test_lookup(value, term):
    assert Dictionary(TERMS).lookup(value) == term


def test_deletions_and_distance():
    assert deletions("abc") == {"abc", "ab", "ac", "bc", "a", "b", "c"} and deletions("a") == {"a"} and deletions("") == {""}
    assert typing_distance("abcd", "abdc", 3) == 0.8 and typing_distance("abcd", "abd", 3) == 1.0 and typing_distance("abcd", "abccd", 3) == 0.6
    assert typing_distance("abcd", "xyzw", 2) == float("inf")
    assert fold(" Tissuе  mіcrosсopy\u200b ") == "tissue microscopy" and fold("Перелом") == "перелом"


def test_more_used_entry_wins_a_tie():
    near = [(1, "abcdefgx", None), (2, "abcdefgz", None)]
    assert Dictionary(near, {2: 9}).lookup("abcdefgk") == 2 and Dictionary(near).lookup("abcdefgk") == 1


@pytest.mark.parametrize("most_terms", [10_000, 2])
def test_table(spark, most_terms):
    terms = spark.createDataFrame([*TERMS, (8, None, None), (9, "Renal cyst", None)], "term_id long, name string, short_form string")
    values = [("a", "computed tomographie"), ("b", None), ("c", " \n"), ("d", "nothing like it"), ("e", "renal cysts"), ("e", "renal cysts")]
    df = spark.createDataFrame([(*v, "clash") for v in values], "k string, v string, name string")
    used = use_counts(spark.createDataFrame([("Renal cyst",), (None,)], "x string"), ["x"], terms)
    got = sorted((r["k"], r["term_id"]) for r in map_values(df, "v", terms, used=used, most_terms=most_terms).filter("term_id IS NOT NULL").collect())
    assert got == [("a", 1), ("d", 0), ("e", 7), ("e", 7)]
    assert map_values(df, "v", terms.limit(0)).filter("term_id = 0").count() == 4
    assert map_values(df.limit(0), "v", terms).count() == 0


def test_blocks_of_any_size_give_the_same_answers(spark):
    """Ties that use counts decide, abbreviations of several entries, windows and word orders, whatever block holds what."""
    names = [(i, f"{a} {b}", s) for i, (a, b, s) in enumerate([("Renal", "cyst", "RC"), ("Renal", "cast", None), ("Optic", "nerve head", "ONH"), ("Lung", "nodule", "LN"), ("abcdefg", "x", None), ("abcdefg", "z", None), ("Bone", "marrow oedema", "BMO"), ("Liver", "lesion", "LL")], 1)]
    terms = spark.createDataFrame(names, "term_id long, name string, short_form string")
    uses = spark.createDataFrame([(6, 9), (2, 4)], "term_id long, used long")
    values = ["abcdefg k", "renal cxst", "seen LN and BMO", "seen LN again", "probable cyst, renal", "lung noduls here", "b one marrow oedema", "nothing", "rc", "head optic nerve", " "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {r["v"]: r["term_id"] for r in map_values(df, "v", terms, used=uses).collect()}
    assert want["abcdefg k"] == 6 and want["seen LN and BMO"] == 0 and want["seen LN again"] == 4 and want[" "] is None
    for most in (1, 2, 3, 5):
        assert {r["v"]: r["term_id"] for r in map_values(df, "v", terms, used=uses, most_terms=most).collect()} == want


def test_names_in_other_scripts():
    d = Dictionary([*TERMS, (20, "Компьютерная томография", None), (21, "胸水", None)])
    assert [d.lookup(v) for v in ("компьютерная  томогрфия", "томография компьютерная", "胸水", "胸水？", "Рентген")] == [20, 20, 21, 21, 0]
