import datetime as dt

import pytest
from pyspark.sql import functions as F

from ozalid.functions.scalars import half_even, seconds_text, strip
from ozalid.operators import evaluation as ev
from ozalid.operators import volumes as vol
from ozalid.operators.choices import choices_of, gold_letter, is_accepted
from ozalid.operators.intent import centroids, nearest_centroid, phrase_track
from ozalid.operators.prompts import system_prompts, user_prompt
from ozalid.operators.resolve import resolve_images
from ozalid.operators.sampling import case_split, numbered_ids, seeded_sample, shuffled_choices
from ozalid.operators.scoring import answers, candidate_losses, fallback_reason, final_answer, letter_scores, only_offered
from ozalid.operators.skew import join_by_share, latest_rows, salted_rank
from ozalid.operators.training import masked_labels, training_examples, write_examples

ABCD = "A string, B string, C string, D string"


def choices(spark, rows, stripped=True):
    return spark.createDataFrame(rows, ABCD).withColumn("c", choices_of([F.col(k) for k in "ABCD"], stripped))


@pytest.mark.parametrize(
    ("row", "letters", "ok"),
    [(("a", "b", "c", "d"), "ABCD", True), (("a", "b", None, ""), "AB", True), (("a", "b", "c", None), "ABC", False), (("a", None, "c", None), "AC", False), (("a", "  ", None, None), "A", False), ((None,) * 4, "", False)],
)
def test_choices_and_guard(spark, row, letters, ok):
    r = choices(spark, [row]).select(F.array_join(F.transform("c", lambda x: x["letter"]), ""), is_accepted(F.col("c"))).first()
    assert tuple(r) == (letters, ok)


def test_unstripped_blank_choice_is_offered(spark):
    assert choices(spark, [("a", " ", None, None)], stripped=False).select(F.size("c")).first()[0] == 2


@pytest.mark.parametrize(
    ("answer", "row", "letter"),
    [("b", ("x", "y", None, None), "B"), (" Benign Lesion ", ("benign lesion", "y", None, None), "A"), ("C", ("x", "y", None, None), "C"), ("same", ("same", "y", "same", None), "A"), ("other", ("x", "y", None, None), None), (None, ("x", "y", None, None), None), ("B\n", ("x", "b", None, None), "B")],
)
def test_gold_letter(spark, answer, row, letter):
    assert choices(spark, [row]).select(gold_letter(F.lit(answer).cast("string"), F.col("c"))).first()[0] == letter


def test_strip_and_rounding(spark):
    r = spark.range(1).select(strip(F.lit("\t\xa0 a b\n　")), half_even(F.lit(2.5)), half_even(F.lit(3.5)), seconds_text(F.lit(0.00005)), seconds_text(F.lit(0.29135))).first()
    assert tuple(r) == ("a b", 2, 4, "%.4f" % 0.00005, "%.4f" % 0.29135)


def test_seconds_text_is_pythons(spark):
    values = [k / 100000 for k in range(5, 400000, 1390)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", seconds_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == ["%.4f" % r["v"] for r in got]


@pytest.mark.parametrize(
    ("question", "track"),
    [("Which LOBE is affected?", "spatial"), ("upgrade of the system", None), ("bi-rads grade?", "severity"), ("étage", None), ("What is the most likely diagnosis", "diagnostic"), (None, None), ("", None), ("rule out, or what type of scan", "modality_id")],
)
def test_phrase_track(spark, question, track):
    assert spark.range(1).select(phrase_track(F.lit(question).cast("string"))).first()[0] == track


def test_prompts(spark):
    c = choices(spark, [("x", "y", None, None)]).select(user_prompt(F.lit("Q"), F.col("c"))).first()[0]
    assert c == "Q\n\nA) x\nB) y\n\nAnswer with only the letter."
    p = system_prompts(spark)
    assert p.count() == 20 and p.filter(~F.col("system_prompt").contains("\n\nImaging context: ")).count() == 0


def test_nearest_centroid_ties_and_zero_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (0, [0.0, 1.0])], "label int, v array<double>")
    q = spark.createDataFrame([([1.0, 1.0],), ([0.0, 0.0],), ([2.0, 0.1],)], "v array<double>")
    got = nearest_centroid(q, "v", centroids(e, "label", "v")).select("predicted", "margin").collect()
    assert [r["predicted"] for r in got] == [0, 0, 1]
    assert got[1]["margin"] == 0.0


def test_logits_to_answers(spark):
    logits = spark.createDataFrame([("q1", "A", "a", 1.0), ("q1", "A", "b", 3.0), ("q1", "B", "a", 3.0), ("q1", "C", "a", 9.0), ("q2", "B", "a", 1.0)], "query_id string, letter string, variant string, logit double")
    offered = spark.createDataFrame([("q1", "A"), ("q1", "B"), ("q2", "B")], "query_id string, letter string")
    got = {r["query_id"]: r for r in answers(only_offered(letter_scores(logits), offered)).collect()}
    assert (got["q1"]["answer"], got["q1"]["logit_margin"]) == ("A", 0.0)
    assert (got["q2"]["answer"], got["q2"]["top2_logit"]) == ("B", None)


def test_losses_are_masked_and_negated(spark):
    losses = spark.createDataFrame([("q", "A", 0, 99.0), ("q", "A", 2, 1.0), ("q", "B", 2, 0.5), ("q", "B", 3, 1.0)], "query_id string, letter string, pos int, nll double")
    r = answers(candidate_losses(losses, 2)).first()
    assert (r["answer"], r["top1_logit"]) == ("B", -0.75)


@pytest.mark.parametrize(
    ("state", "reason", "answer"),
    [((True, True, True, True, True), None, "C"), ((False, False, False, False, False), "malformed_choices", "A"), ((True, False, True, True, True), "image_load_failed", "C"), ((True, True, False, True, True), "pipeline_stage_failed", "C"), ((True, True, False, False, False), "pipeline_failed_on_gray_canvas", "A"), ((True, True, True, True, False), "inference_timeout", "A"), ((True, False, True, True, False), "image_load_failed+inference_timeout", "A")],
)
def test_fallback_states(spark, state, reason, answer):
    df = spark.createDataFrame([state], "a boolean, b boolean, c boolean, d boolean, e boolean").withColumn("r", fallback_reason(*[F.col(k) for k in "abcde"]))
    assert tuple(df.select("r", final_answer(F.lit("C"), F.col("r"))).first()) == (reason, answer)


def test_bootstrap(spark):
    assert ev.bootstrap_counts(0, 0) == (0.0, 0.0)
    low, high = ev.bootstrap_counts(1000, 600)
    assert 56 < low < 58 and 62 < high < 64
    exact, drawn = ev.bootstrap_flags([1] * 600 + [0] * 400), ev.bootstrap_counts(1000, 600)
    assert all(abs(a - b) < 0.4 for a, b in zip(exact, drawn, strict=True)) and ev.bootstrap_flags([]) == (0.0, 0.0)
    df = spark.createDataFrame([("x", True)] * 3 + [("y", None)], "m string, correct boolean")
    got = {r["m"]: (r["n"], r["low"], r["high"]) for r in ev.bootstrap(df, ["m"]).collect()}
    assert got == {"x": (3, 100.0, 100.0), "y": (0, 0.0, 0.0)}


def test_summary_of_nothing(spark):
    r = ev.summary(spark.createDataFrame([], "correct boolean, fallback_triggered boolean, inference_time double")).first()
    assert (r["total"], r["correct_rows"], r["accuracy"]) == (0, 0, None)


@pytest.mark.parametrize(("n", "fraction", "evals"), [(0, 0.2, 0), (1, 0.2, 1), (2, 0.2, 1), (12, 0.2, 2), (13, 0.2, 3), (5, 0.5, 2), (7, 0.5, 4)])
def test_case_split_counts(spark, n, fraction, evals):
    df = spark.range(n).selectExpr("cast(id AS string) AS c")
    assert case_split(df, "c", fraction, 1).filter("split = 'eval'").count() == evals


def test_case_split_keeps_cases_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "c string, x int")
    got = case_split(df, "c", 0.5, 3).collect()
    assert len(got) == 4 and len({r["split"] for r in got if r["c"] == "a"}) == 1
    assert [r["split"] for r in got if r["c"] is None] == ["train"]


def test_sample_ids_and_shuffle(spark):
    df = spark.range(100).selectExpr("cast(id AS string) AS k")
    assert seeded_sample(df, "k", 10, 1).count() == 10 and seeded_sample(df, "k", 0, 1).count() == 100
    ids = [r["question_id"] for r in numbered_ids(df, "n", "k").orderBy("k").collect()]
    assert ids == [f"n_{i:05d}" for i in range(100)]
    c = choices(spark, [("a", "b", "c", "d")]).select(shuffled_choices(F.col("c"), 1, 2, F.lit("q")).alias("s")).first()["s"]
    assert [x["letter"] for x in c] == list("ABCD") and sorted(x["text"] for x in c) == list("abcd")


def test_resolve_images(spark):
    listing = spark.createDataFrame([("/d/x.png",), ("/d/Images/x (1).png",), ("/d/Images/0002 (1).PNG",), ("/d/Images/case7",), ("/abs/y.png",)], "path string")
    cells = [("1", "x.png"), ("2", "0002.png"), ("3", "case7"), ("4", None), ("5", ""), ("6", "none.png"), ("7", "/abs/y.png"), ("8", "sub/0002.png"), ("9", "case8")]
    got = {r["k"]: r["resolved_path"] for r in resolve_images(spark.createDataFrame(cells, "k string, image string"), "k", "image", listing, "/d").collect()}
    assert got == {"1": "/d/x.png", "2": "/d/Images/0002 (1).PNG", "3": "/d/Images/case7", "4": None, "5": None, "6": None, "7": "/abs/y.png", "8": "/d/Images/0002 (1).PNG", "9": None}


def test_pick_slices(spark):
    rows = [("v", i, s, 40) for i, s in enumerate([0.1] * 40)]
    rows[10], rows[11], rows[30], rows[20] = ("v", 10, 9.0, 40), ("v", 11, 8.0, 40), ("v", 30, 7.0, 40), ("v", 20, 6.0, 40)
    rows += [("w", i, float(i), 2) for i in range(2)] + [("t", i, float(i), 4) for i in range(4)]
    got = {r["volume"]: r["picked"] for r in vol.pick_slices(spark.createDataFrame(rows, "volume string, i int, s double, d int"), "volume", "i", "s", "d").collect()}
    assert got == {"v": [10, 20, 30], "w": [0, 1], "t": [1, 2, 3]}


def test_windows_and_depths(spark):
    r = spark.createDataFrame([(5.0, 2.0, 2.0, 1.0, 9.0), (5.0, 0.0, 10.0, 0.0, 10.0), (3.0, 3.0, 3.0, 3.0, 3.0)], "v double, lo double, hi double, least double, most double")
    assert [x[0] for x in r.select(vol.to_byte(*[F.col(c) for c in r.columns])).collect()] == [127, 127, 0]
    d = spark.createDataFrame([(1,), (10,), (300,)], "d int").select(vol.fixed_depths(F.col("d")), vol.stride(F.col("d"))).collect()
    assert [tuple(x) for x in d] == [([0, 0, 0], 1), ([3, 4, 6], 1), ([105, 150, 194], 2)]


def test_series_and_shapes(spark):
    rows = [("s", 3, None, "a", "2x2"), ("s", 1, None, "b", "2x2"), ("t", None, 2.0, "a", "2x2"), ("t", 1, 1.0, "b", "1x1"), ("u", None, None, "b", "x"), ("u", 1, None, "a", "y")]
    got = vol.series_order(spark.createDataFrame(rows, "s string, n int, z double, p string, shape string"), "s", "n", "z", "p")
    order = {}
    for r in got.orderBy("s", "position").collect():
        order.setdefault(r["s"], []).append(r["p"])
    assert order == {"s": ["b", "a"], "t": ["b", "a"], "u": ["a", "b"]}
    shapes = {r["s"]: r["shape"] for r in vol.majority_shape(got, "s", "shape", "position").collect()}
    assert shapes == {"s": "2x2", "t": "1x1", "u": "y"}


def test_training_examples(spark, tmp_path):
    df = spark.createDataFrame([("1", "ab", "c"), ("2", None, "c")], "k string, p string, a string")
    encode = lambda d, t, keep: d.select(*keep, F.expr(f"transform(split({t}, ''), x -> ascii(x))").alias("ids"))
    assert [tuple(r) for r in training_examples(df, encode, "k", "p", "a").collect()] == [("1", [97, 98, 99], [-100, -100, 99])]
    with_image = df.withColumn("i", F.when(F.col("k") != "3", F.lit("x.png")))
    built, skipped = write_examples(with_image, encode, "k", "p", "a", "i", str(tmp_path / "e"))
    assert (built.count(), skipped) == (1, 1)
    with pytest.raises(ValueError):
        write_examples(with_image.filter("k = '2'"), encode, "k", "p", "a", "i", str(tmp_path / "n"))
    assert spark.range(1).select(masked_labels(F.array(F.lit(1), F.lit(2)), F.lit(1))).first()[0] == [-100, 2]


def test_latest_rows_and_joins_by_share(spark):
    t = dt.datetime(2031, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t + dt.timedelta(1), 2), (None, t, 3)], "k string, at timestamp, v int")
    assert [(r["k"], r["v"]) for r in latest_rows(df, "k", "at").collect()] == [("a", 2)]
    big = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 'hot' ELSE cast(id AS string) END AS k", "id")
    table = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = join_by_share(big, table, "k", "n", 3000)
    assert got.count() == 3000 and got.filter("k = 'hot' AND first = 0").count() == 1000
    assert join_by_share(big, table.filter("k = 'hot'"), "k", "n", 3000, "left_semi").count() == 1000


def test_salted_rank_is_a_rank(spark):
    df = spark.range(1000).selectExpr("id % 3 = 0 AS k", "CASE WHEN id < 5 THEN NULL ELSE 1 END AS j", "id", "xxhash64(id) AS h")
    got = salted_rank(df, ["k", "j"], [F.col("h"), F.col("id")], buckets=7).collect()
    by = {}
    for r in got:
        by.setdefault((r["k"], r["j"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(got) == 1000
