import html

import pytest

from ozalid.llm.garbled import ODDS, Model, as_utf8, garbled, once, search_rare, seeker_keys, target_keys

CLEAN = ["größer", "épanchement", "Дыхание", "正常", "μm", "“Halo”", "image", "is", "coração", "Ø", "Łódź", "naïve"]


@pytest.fixture(scope="module")
def model():
    return Model([(w, 100) for w in sorted(CLEAN)], 100 * len(CLEAN))


def twice(w):
    return w.encode().decode("cp1252").encode().decode("cp1252")


@pytest.mark.parametrize(
    ("bad", "good"),
    [("größer".encode().decode("cp1252"), "größer"), ("größer".encode("latin-1").decode("cp1251"), "größer"), ("Дыхание".encode("cp1251").decode("latin-1"), "Дыхание"), ("Дыхание".encode().decode("cp1251", "replace"), "Дыхание"), ("正常".encode().decode("gb18030", "replace"), "正常"), ("“Halo”".encode("cp1252").decode("latin-1"), "“Halo”"),
     (twice("coração"), "coração"), ("größer".encode().decode("mac-roman"), "größer"), ("épanchement".encode().decode("cp437"), "épanchement"), ("gr�ßer", "größer"), ("gr??er", "größer"), ("ã©panchement", "épanchement"), ("\xef\xbb\xbfimage", "image"), ("naïve".encode("utf-7").decode(), "naïve"), (html.escape("coração").encode().decode("cp1252").replace("Ã", "&Atilde;"), "coração"), ("Å\x81Ã³dÅº", "Łódź")],
)
def test_restores(model, bad, good):
    assert model.decode(bad) == good


@pytest.mark.parametrize("word", [*CLEAN, "Größe", "image?", "é", "", "???", "A&B", "1+1", "c++;", "\ufeffimage", "ÉPANCHEMENT"])
def test_leaves_clean_words(model, word):
    assert model.decode(word) is None


def test_once_keeps_what_is_right():
    assert once("Ã© é Ã", "cp1252") == "é é Ã"


def test_values(spark):
    rows = [("Le cœur 12 mm",)] * 40 + [("Le cÅ“ur 7 mm",), (None,), ("",), ("  ",), ("x \x92 y",), ("Le c�ur\n 3 mm",), ("cœur " * 20000,), ("Le cÅ“ur 7 mm",)]
    got = {r["value"]: (r["copies"], r["restored"]) for r in garbled(spark.createDataFrame(rows, "value string")).collect()}
    assert got == {"Le cÅ“ur 7 mm": (2, "Le cœur 7 mm"), "x \x92 y": (1, None), "Le c�ur\n 3 mm": (1, "Le cœur\n 3 mm")}
    assert garbled(spark.createDataFrame([], "value string")).count() == 0


def test_odds(spark):
    rows = [("Ø",)] * (ODDS * 3) + [("Ã˜",)] * 4
    assert {r["value"] for r in garbled(spark.createDataFrame(rows, "value string")).collect()} == set()
    rows += [("Ø",)] * 100
    assert {r["value"] for r in garbled(spark.createDataFrame(rows, "value string")).collect()} == {"Ã˜"}


def test_copies_of_a_garbled_value(spark):
    """More than a fifth of a word's occurrences garbled: copies of one value, of UTF-8 and of another encoding."""
    clean = [(f"größer {w} Дыхание",) for w in ("als", "im", "am", "zum", "vom", "beim", "links", "rechts")]
    utf8, other = ("größer".encode().decode("cp1252"), "Дыхание".encode("cp1251").decode("latin-1"))
    rows = clean * 5 + [(f"{utf8} hier",)] * 60 + [(f"{other} hier",)] * 60
    got = {r["value"]: (r["copies"], r["restored"]) for r in garbled(spark.createDataFrame(rows, "value string")).collect()}
    assert got == {f"{utf8} hier": (60, "größer hier"), f"{other} hier": (60, "Дыхание hier")}


def test_language_garbled_throughout(spark):
    words = ["Πνεύμονας", "καρδιά", "ήπαρ", "νεφρός", "και", "ή"]
    rows = [(f"{a} {b}",) for a in words for b in words]
    bad = [(v.encode().decode("cp1253", "replace") if i % 2 else "".join(bytes((b,)).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in v.encode()),) for i, (v,) in enumerate(rows)]
    got = {r["value"]: r["restored"] for r in garbled(spark.createDataFrame(bad, "value string")).collect()}
    want = {b: v for (b,), (v,) in zip(bad, rows, strict=True) if "�" not in b and v != "ή ή"}
    assert len(want) > 15 and {b: got.get(b) for b in want} == want


@pytest.mark.parametrize("word", ["Её", "её", "рок", "шаг", "хан", "Úžas", "KÓŁ", "CAFÉ”", "MANHÃ”", "联通", "中国", "一", "“Halo”", "l’Île", "3×½", "Größe", "voilà»"])
def test_right_text_is_not_surely_utf8(word):
    assert not (as_utf8(word) or ("", False))[1]


@pytest.mark.parametrize("wrong", ["cp1252", "mac-roman", "cp437", "cp850", "gb18030"])
def test_surely_utf8(wrong):
    for word in ("größer", "Дыхание"):
        bad = word.encode().decode(wrong, "replace")
        assert "�" in bad or as_utf8(bad) == (word, True)


def test_words_outside_the_model(spark):
    """Words below the model's share: UTF-8 that stands nowhere undamaged, and other encodings by the counts of all words."""
    name = "Иванченко"
    rows = [("a b c d e f g h i j",)] * 100_000 + [(f"{name} {i % 2}",) for i in range(8)]
    bad = {"von Gr\xc3\xb6n\xc3\xb6ck": "von Grönöck", f"x {name.encode('cp1251').decode('latin-1')}": f"x {name}"}
    got = {r["value"]: r["restored"] for r in garbled(spark.createDataFrame(rows + [(v,) for v in bad], "value string")).collect()}
    assert got == bad


def test_damaged_words_outside_the_model(spark):
    """The whole search covers words below the model's share, too: replaced, lost and changed characters."""
    rows = [("a b c d e f g h i j",)] * 100_000 + [(f"Иванченко Grönöck {i % 4}",) for i in range(8)]
    bad = {"x Ива?ченко": "x Иванченко", "y gr\xe3\xb6n\xe3\xb6ck": "y Grönöck", "z Gr\ufffdnöck": "z Grönöck", "w Gr\xc3n\xc3\xb6ck": "w Grönöck"}
    got = {r["value"]: r["restored"] for r in garbled(spark.createDataFrame(rows + [(v,) for v in bad], "value string")).collect()}
    assert got == bad


def test_rare_words_in_blocks(spark, model):
    """For any size of blocks the same answers as one model gives, for wide characters with ASCII bytes, too."""
    targets = [*CLEAN, "正常病变肺部感染肺炎肿瘤", "ソニー表示", "größe"]
    bad = [twice("coração"), "gr�ßer", "gr??er", "ã©panchement", "größer".encode().decode("gb18030", "replace"), "Å\x81Ã³dÅº", "正常病变肺部感染肺炎肿瘤".encode("gb18030").decode("big5", "replace"), "ソニー表示".encode("cp932").decode("gb18030", "replace"), "ソニー表示".encode("cp932").decode("cp1252", "replace"), "image", "größer"]
    whole = Model([(w, 100) for w in sorted(targets)], 100 * len(targets))
    want = {}
    for w in bad:
        whole.count.setdefault(w, 1)
        whole.places.setdefault(w, 1)
        if hit := whole.cheapest(w):
            want[w] = (pytest.approx(hit[0]), hit[1])
            assert seeker_keys(w) & target_keys(hit[1])
    assert len(want) >= 8
    of = spark.createDataFrame([(w, 100, 100, w) for w in targets], "word string, n long, places long, final string")
    by = spark.createDataFrame([(w, 1, 1) for w in bad], "word string, n long, places long")
    for block in (2, 1000):
        assert {r["word"]: (r["cost"], r["restored"]) for r in search_rare(by, of, 100 * len(targets), block).collect()} == want


def test_words_that_are_not_likelier_hide_no_others():
    m = Model([("ápanchement", 150), ("épanchement", 120), ("\ufffdpanchement", 40)], 1000, {"ápanchement": 1, "épanchement": 10, "\ufffdpanchement": 1})
    assert m.decode("\ufffdpanchement") == "épanchement"


def test_any_rounds_and_damage():
    words = ["größer", "正常", "é" * 30 + "a", "a😀b"]
    m = Model([(w, 100) for w in words], 400)
    often = "größer"
    for _ in range(9):
        often = often.encode().decode("latin-1")
    for bad, good in ((often, "größer"), ("正常".encode()[:-2].decode("cp1252"), "正常"), ("?" * 30 + "a", words[2]), ("a\ufffdb", "a😀b")):
        assert m.decode(bad) == good
