import math
import random

import pytest

from ozalid.llm.overlap import LEAST_ASKED, core_question, image_key, indexed, is_light, overlaps, prepare, same_question, typed_for, with_image_key
from pyspark.sql import functions as F

BASE = "Which finding is most likely near the upper border of this CT image?"
SHAPE = "question_id string, dataset string, question string, image_path string, split string"


def alike(spark, *pairs):
    """Which of the pairs of questions overlap, each pair on an image of its own beside 300 well-written questions."""
    usual = [BASE, BASE.replace("upper", "lower"), BASE.replace("CT", "MRI"), "What does the eye or the lip show at the top of this image?", "Is the LAD or the RCA seen low in this picture?"]
    rows = [(f"u{n}", "D", usual[n % 5], f"i/u0000{n}.png", "train") for n in range(300)]
    for k, (a, b) in enumerate(pairs):
        rows += [(f"a{k}", "D", a, f"i/p1000{k}.png", "train"), (f"b{k}", "D", b, f"i/p1000{k}.png", "test")]
    got = {r["train_id"] for r in overlaps(prepare(spark.createDataFrame(rows, SHAPE))).collect()}
    return [f"a{k}" in got for k in range(len(pairs))]


def test_same(spark):
    others = ["which finding is most likely near the upper border of the CT image", "[VQA] " + BASE, "12. " + BASE, "<image>\n" + BASE, "Please answer: " + BASE, BASE + " Select the best option.", BASE + " (one answer)", "Whihc finding is most likely near near the uper border of this CT imgae?", BASE.replace("o", "\u043e"), BASE.upper(), "  " + BASE.replace(" ", "\xa0") + "??"]
    assert alike(spark, *[(BASE, o) for o in others]) == [True] * len(others)


def test_other(spark):
    others = [BASE.replace("upper", "lower"), BASE.replace("finding", "structure"), BASE.replace("near the upper border", "in the left half"), "What orientation does the CT picture have?", "", BASE.replace("is most", "is not most"), BASE.replace("CT", "MRI")]
    pairs = [(BASE, o) for o in others] + [(f"Is this the {a} of the image?", f"Is this the {b} of the image?") for a, b in (("LAD", "RCA"), ("eye", "lip"), ("top", "low"), ("left", "right"))]
    assert alike(spark, *pairs) == [False] * len(pairs)


def test_other_scripts(spark):
    pairs = [("Что показано на снимке слева?", "что  показано на снимке слева"), ("Что показано на снимке слева?", "Что показано на снимке справа?"), ("左肺に見える所見は何ですか？", "左肺に見える所見は何ですか"), ("左肺に見える所見は何ですか？", "右肺に見える所見は何ですか？")]
    assert alike(spark, *pairs) == [True, False, True, False]


def test_typing_errors_need_a_frequent_word():
    assert typed_for("lefy", 2, "left", 50) < 1.1 and typed_for("eye", 40, "lye", 30) == float("inf") and typed_for("ct", 1, "mri", 90) == float("inf")
    assert is_light("this", 1, 1000) and is_light("image", 600, 1000) and not is_light("ct", 300, 1000) and not is_light("7", 900, 1000)


def test_words_split_or_run_together():
    def words(text):
        return [(w, w, 1, False) for w in text.split()]

    assert same_question(words("seen near thescale bar"), words("seen near the scale bar")) and not same_question(words("seen near bar"), words("seen near the bar"))


def test_pruning_loses_no_pair():
    """Any two vectors that reach the least cosine share an indexed term, against all pairs of random vectors."""
    rng = random.Random(4)
    for _ in range(30):
        vectors = []
        for _ in range(25):
            v = {t: rng.random() ** 3 + 0.01 for t in sorted(rng.sample(range(14), rng.randint(1, 8)))}
            norm = math.sqrt(sum(w * w for w in v.values()))
            vectors.append({t: w / norm for t, w in v.items()})
        most = {t: max(v.get(t, 0) for v in vectors) for t in range(14)}
        kept = [set(indexed(list(v), list(v.values()), [most[t] for t in v], LEAST_ASKED)) for v in vectors]
        assert sum(map(len, kept)) < sum(map(len, vectors))
        for i, a in enumerate(vectors):
            for j, b in enumerate(vectors):
                if sum(w * b.get(t, 0) for t, w in a.items()) >= LEAST_ASKED:
                    assert kept[i] & kept[j]


@pytest.mark.parametrize("path", ["Images/Fam/abc00000123_ax_002.png", "/mnt/mirror4/Images//Fam/abc00000123_ax_002 (3).PNG", "file:///mirror/Other/abc00000123%5Fax%5F002%20(1).jpeg", " Fam/abc00000123_ax_002.png?v=3 ", "D:\\mirror\\Fam\\abc00000123_ax_002.jpg", "ABC123_AX_2.png".replace("123", "00123")])
def test_image_key(spark, path):
    assert spark.range(1).select(image_key(F.lit(path))).first()[0] == "abc123_ax_2"


@pytest.mark.parametrize(("path", "key"), [("Images/F/abc_case00000007/slice_001.nii.gz", "abc_case7/slice_1"), ("./x/abc_case00000007/slice_012.png", "abc_case7/slice_12"), ("a/b/c.png", "b/c"), ("  ", None), (None, None), ("50%.png", "50%")])
def test_image_key_of_slices(spark, path, key):
    assert spark.range(1).select(image_key(F.lit(path).cast("string"))).first()[0] == key


def test_image_key_in_steps(spark):
    paths = ["/mnt/m/Images//F/abc00000123_ax_002 (3).PNG", "f/abc%2500000123.png", None, " ", "a\\b\\c_case00000007\\slice_1.nii.gz"]
    df = with_image_key(spark.createDataFrame([(p,) for p in paths], "p string"), "p", "k").withColumn("other", image_key(F.col("p")))
    assert all(r["k"] == r["other"] for r in df.collect())


def test_pairs_equal_brute_force(spark):
    asked = [f"Which {f} is seen {p} of this {m} image?" for f in ("finding", "structure", "organ", "device") for p in ("near the upper border", "near the lower border", "in the left half", "in the right half") for m in ("CT", "MRI", "PET")]
    rows = [(f"i{n}", "D", (asked + [None, ""])[(n * 7 + n // 50) % 50], None if n % 11 == 0 else f"Images/D/x0000{n % 3 if n % 4 else 0}_ax_001.png", ("train", "test", "validation", None)[n % 5 % 4], "extra") for n in range(900)]
    items = spark.createDataFrame(rows, SHAPE + ", image string")
    got = {(r["train_id"], r["eval_id"]) for r in overlaps(prepare(items.drop("image"))).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[4] == "train" and b[4] not in ("train", None) and a[3] and a[3] == b[3] and a[2] and a[2] == b[2]}
    assert got == want and want


def test_hot_image_and_empty_sides(spark):
    rows = [(f"i{n}", "D", BASE, "Images/D/x00001_ax_001.png", "train" if n % 2 else "test") for n in range(60)]
    assert overlaps(prepare(spark.createDataFrame(rows, SHAPE))).count() == 900
    assert overlaps(prepare(spark.createDataFrame([r for r in rows if r[4] == "train"], SHAPE))).count() == 0
    assert overlaps(prepare(spark.createDataFrame([], SHAPE))).count() == 0
