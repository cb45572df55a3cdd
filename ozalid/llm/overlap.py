"""Same or near-same records across splits: a weighted cosine join between train and the evaluation splits.

A record's vector has one term for its image (canonical path) with IMAGE of the squared norm, and the words of its
question, weighted by how rare they are, with the rest. Words that are typing errors of a word ODDS times as frequent
stand for that word. As 1 - IMAGE < LEAST, two records without the same image can't reach LEAST: the image term is part
of every indexed term. Of the question's terms, rarest first, only those are indexed that the rest could not replace: the
rest is cut where its norm (residual-norm pruning) or its greatest possible dot product, each weight times the term's
greatest weight in any vector (maximum-weight pruning), is below what must still be reached. Both sides are cut in one
global order of terms, so two vectors that reach LEAST share an indexed term. The inverted lists of (image, term) give the
candidates between splits; exact dot products and a word alignment are computed once per distinct pair of questions;
matches expand to records last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ozalid.llm.canonical import deletions
from ozalid.llm.textfold import fold, typing_distance
from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage

IMAGE = 0.6
#: What the questions' cosine and that of the whole vectors must reach.
LEAST_ASKED = 0.7
LEAST = IMAGE + (1 - IMAGE) * LEAST_ASKED
assert 1 - IMAGE < LEAST**2, "every indexed term holds the image"
#: A word is taken for a typing error of a near one that stands so many times as often.
ODDS = 20
#: A word in half of all records or more says nothing about what is asked; so many records more are asked for in small tables.
SMALL = 20
#: Words longer than this are compared as they stand.
LONGEST = 40


def image_key(path: Column) -> Column:
    """One writing of an image path: see with_image_key."""
    # one expression, for single values; with_image_key computes each step once
    return _key(_bare(_slashed(_decoded(_plain(path)))))


def _plain(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(path, r"[\s ]+", " ")))


def _decoded(plain: Column) -> Column:
    return F.when(F.contains(plain, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2b"))), plain)).otherwise(plain)


def _slashed(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"[?#].*$", ""), "/{2,}", "/")


def _bare(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(path), r"(\.nii\.gz|\.[a-z][a-z0-9]{1,4})$", ""), r" ?\([0-9]+\)$", ""))


def _key(bare: Column) -> Column:
    last = F.substring_index(bare, "/", -1)
    key = F.when(last.rlike("[0-9]{5}"), last).otherwise(F.substring_index(bare, "/", -2))
    return F.nullif(F.regexp_replace(key, r"(?<![0-9])0+(?=[0-9])", ""), F.lit(""))


def with_image_key(df: DataFrame, path: str, out: str) -> DataFrame:
    """df with `out`, one writing of the image path df[path]: decoded, lower case, forward slashes, without mirror folders,
    query, copy mark ' (n)', suffix and leading zeros. Kept is the last component if it has a number of five digits or
    more, else the last two. NULL for NULL and blank paths."""
    for step in (_plain, _decoded, _slashed, _bare, _key):
        df = df.withColumn(out, step(F.col(path)))
        path = out
    return df


_LEAD = re.compile(r"^(?:<[^>]*>|\[[^\]]*\]|\(?\d+[.):]|[a-z]+(?: [a-z]+)? ?:)\s+")
_TAIL = re.compile(r"\s*[\(\[][^\)\]]*[\)\]]\s*$")
_AFTER = re.compile(r"^(.{12,}?[?.!:？。！])\s+((?:\S+ ){0,5}\S+)$")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])[^\W_])+")


def core_question(text: str) -> str:
    """The words asked, of any script (ideographs one by one): folded, without leading labels and numbers, closing
    instructions or remarks and doubled words."""
    t = fold(text)
    while True:
        s = _TAIL.sub("", _LEAD.sub("", t))
        if m := _AFTER.match(s):
            s = m[1]
        if s == t or not s:
            break
        t = s
    words = _WORD.findall(t)
    return " ".join(w for i, w in enumerate(words) if i == 0 or w != words[i - 1])


# Articles and demonstratives, which name nothing.
_POINTING = frozenset(("a", "an", "the", "this", "that", "these", "those"))


def is_light(word: str, n: int, total: int) -> bool:
    """Whether a word may come, go or change without changing what is asked: it points, or stands in half of all records."""
    return word in _POINTING or (2 * n >= total + SMALL and not word.isdigit())


def edits_of(word: str) -> int:
    """Edits by which a word may be a typing error of another."""
    return 0 if word.isdigit() or len(word) > LONGEST else 1 if len(word) <= 4 else 2


def typed_for(a: str, n: int, b: str, m: int) -> float:
    """The distance at which a (standing n times) is a typing error of b (m times); infinity if it is none.

    Of two words that both stand often enough to be words, neither is an error of the other; two rare ones may be
    writings of one word if they are long.
    """
    short = min(len(a), len(b))
    if m < ODDS * n and (max(n, m) >= ODDS or short < 5):
        return float("inf")
    edits = min(edits_of(a), edits_of(b))
    return typing_distance(a, b, 1.0 if short <= 4 else 2.0) if edits else float("inf")


Word = tuple[str, str, int, bool]  # as written, what it stands for, how often it is written, light


def _same_word(a: Word, b: Word) -> bool:
    if a[1] == b[1] or a[0] == b[0] or (a[3] and b[3]):
        return True
    one, other = (a, b) if a[2] <= b[2] else (b, a)
    return typed_for(one[0], one[2], other[0], other[2]) < float("inf")


def same_question(x: list[Word], y: list[Word]) -> bool:
    """True if two questions align word by word, up to typing errors, light words and words split or run together."""
    reach = {(0, 0)}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if (i, j) not in reach:
                continue
            if i < len(x) and j < len(y) and _same_word(x[i], y[j]):
                reach.add((i + 1, j + 1))
            if i < len(x) and x[i][3]:
                reach.add((i + 1, j))
            if j < len(y) and y[j][3]:
                reach.add((i, j + 1))
            if i < len(x) and j + 1 < len(y) and len(x[i][0]) > 5 and x[i][0] == y[j][0] + y[j + 1][0]:
                reach.add((i + 1, j + 2))
            if j < len(y) and i + 1 < len(x) and len(y[j][0]) > 5 and y[j][0] == x[i][0] + x[i + 1][0]:
                reach.add((i + 2, j + 1))
    return (len(x), len(y)) in reach


def indexed(terms: list[str], weights: list[float], greatest: list[float], least: float) -> list[str]:
    """The terms to index of a unit vector whose terms are in the global order: all but the longest rest that alone can't
    reach `least` with any vector, by its norm or by the greatest weights that its terms have anywhere."""
    square = product = 0.0
    keep = len(terms)
    for k in range(len(terms) - 1, -1, -1):
        square += weights[k] * weights[k]
        product += weights[k] * greatest[k]
        if min(square**0.5, product) >= least - 1e-9:
            break
        keep = k
    return terms[:keep]


def prepare(items: DataFrame) -> DataFrame:
    """(question_id, dataset, split, image, asked) of the items that can overlap: a path, words in the question and a split;
    image is NULL where the path is blank.

    items: one row per question_id. asked is cached per worker, so repeated questions cost a lookup.
    """

    @F.pandas_udf("string")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for texts in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for t in texts.array:
                if t is None:
                    out.append(None)
                    continue
                if (c := known.get(t)) is None:
                    c = known[t] = core_question(t)
                out.append(c)
            yield pd.Series(out, dtype=object)

    given = items.filter("question IS NOT NULL AND image_path IS NOT NULL AND split IS NOT NULL")
    keyed = with_image_key(given.select("question_id", "dataset", "split", "question", "image_path"), "image_path", "image")
    # a filter on the image here would be pushed down and compute all its steps several times over
    return keyed.select("question_id", "dataset", "split", "image", asked("question").alias("asked")).filter("asked <> ''")


def _corrected(words: DataFrame) -> DataFrame:
    """(word, n, rows, canon, m): every word with the word it stands for and how often that one is written.

    Near words meet by the strings that deletions of up to two characters leave of them; nothing is broadcast.
    """

    @F.pandas_udf("array<string>")
    def left(s: pd.Series) -> pd.Series:
        return s.map(lambda w: sorted(deletions(w, e)) if (e := edits_of(w)) else [])

    @F.pandas_udf("double")
    def distance(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([typed_for(*x) for x in zip(a.array, n.array, b.array, m.array, strict=True)], dtype="float64")

    each = words.select("word", "n", F.explode(left("word")).alias("d"))
    rare, common = each.select(F.col("word"), F.col("n"), "d"), each.select(F.col("word").alias("canon"), F.col("n").alias("m"), "d")
    pairs = rare.join(common, "d").filter(F.col("m") >= ODDS * F.col("n")).select("word", "n", "canon", "m").distinct()
    near = pairs.withColumn("far", distance("word", "n", "canon", "m")).filter(F.col("far") < float("inf"))
    best = near.groupBy("word").agg(F.min_by(F.struct("canon", "m"), F.struct("far", -F.col("m"), "canon")).alias("x")).select("word", "x.*")
    return words.join(best, "word", "left").select("word", "n", "rows", F.coalesce("canon", "word").alias("canon"), F.coalesce("m", "n").alias("m"))


def vectors(asked: DataFrame, total: int) -> DataFrame:
    """(asked, words, terms, weights, index) of distinct questions asked(asked, n): words for the alignment, the unit vector in
    the global order of terms (rare first) and the terms to index."""
    long = cut_lineage(asked.select("asked", "n", F.posexplode(F.split("asked", " ")).alias("pos", "word")))
    words = cut_lineage(_corrected(cut_lineage(long.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))))
    every = long.count()
    known = join_by_share(long.select("asked", "pos", "word"), words, "word", "rows", every)
    weight = F.log(1 + F.lit(float(total)) / F.col("m"))
    terms = known.groupBy("asked", "canon").agg(F.min("m").alias("m"), F.sum(weight).alias("w"))
    norms = terms.groupBy("asked").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = cut_lineage(terms.join(norms, "asked").select("asked", "canon", "m", (F.col("w") / F.col("norm")).alias("u")))
    greatest = unit.groupBy("canon").agg(F.max("u").alias("most"), F.count("*").alias("rows"))
    full = join_by_share(unit, greatest, "canon", "rows", every)
    vector = full.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("m", "canon", "u", "most"))).alias("v"))
    written = known.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "canon", "n"))).alias("words"))

    @F.pandas_udf("array<string>")
    def index(v: pd.Series) -> pd.Series:
        return v.map(lambda x: indexed([t["canon"] for t in x], [t["u"] for t in x], [t["most"] for t in x], LEAST_ASKED))

    return vector.join(written, "asked").select("asked", "words", F.transform("v", lambda t: t["canon"]).alias("terms"), F.transform("v", lambda t: t["u"]).alias("weights"), index("v").alias("index"))


def overlaps(records: DataFrame, train: str = "train") -> DataFrame:
    """All pairs (train_id, eval_id, eval_split, train_dataset, eval_dataset, cosine) of one record of split `train` and
    one of another split with the same image and the same question.

    records: see prepare; read several times, so cut its lineage first. Records without an image are in no pair. Those with the same image and question are
    joined as one class and expand at the end: no link between records is lost and none is computed twice. Questions of
    a hot image meet only where they share an indexed term. Empty splits give no rows.
    """
    records = records.filter("image IS NOT NULL")
    sided = records.withColumn("side", F.col("split") == train)
    distinct = cut_lineage(records.groupBy("asked").agg(F.count("*").alias("n")))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = cut_lineage(vectors(distinct, total).join(distinct, "asked"))
    # an image of one side only meets nothing
    lists = sided.groupBy("image", "asked", "side").agg(F.count("*").alias("n"))
    both = lists.groupBy("image").agg(F.bool_or("side").alias("a"), F.bool_or(~F.col("side")).alias("b"), F.count("*").alias("rows"), F.sum("n").alias("records")).filter("a AND b").select("image", "rows", "records")
    both = cut_lineage(both)
    classes = cut_lineage(join_by_share(lists, both.select("image", "rows"), "image", "rows", total))
    asked_rows = classes.groupBy("asked").agg(F.count("*").alias("rows"))
    table = known.select("asked", "index").join(asked_rows, "asked")
    posted = join_by_share(classes.select("image", "asked", "side"), table, "asked", "rows", total).select("image", "asked", "side", F.explode("index").alias("term"))
    left = posted.filter("side").select("image", "term", F.col("asked").alias("asked_1"))
    right = posted.filter("NOT side").select("image", "term", F.col("asked").alias("asked_2"))
    candidates = cut_lineage(left.join(right, ["image", "term"]).select("image", "asked_1", "asked_2").distinct())

    @F.pandas_udf("double")
    def cosine(w1: pd.Series, t1: pd.Series, u1: pd.Series, w2: pd.Series, t2: pd.Series, u2: pd.Series) -> pd.Series:
        def words(given) -> list[Word]:
            return [(x["word"], x["canon"], x["n"], is_light(x["canon"], x["n"], total)) for x in given]

        out = []
        for a, ta, ua, b, tb, ub in zip(w1.array, t1.array, u1.array, w2.array, t2.array, u2.array, strict=True):
            other = dict(zip(tb, ub, strict=True))
            d = sum(u * other.get(t, 0.0) for t, u in zip(ta, ua, strict=True))
            out.append(IMAGE + (1 - IMAGE) * d if d >= LEAST_ASKED and same_question(words(a), words(b)) else 0.0)
        return pd.Series(out, dtype="float64")

    different = candidates.filter("asked_1 <> asked_2").select("asked_1", "asked_2").distinct()
    one = known.select(F.col("asked").alias("asked_1"), F.col("words").alias("w1"), F.col("terms").alias("t1"), F.col("weights").alias("u1"))
    two = known.select(F.col("asked").alias("asked_2"), F.col("words").alias("w2"), F.col("terms").alias("t2"), F.col("weights").alias("u2"))
    pairs = different.join(one, "asked_1").join(two, "asked_2").select("asked_1", "asked_2", cosine("w1", "t1", "u1", "w2", "t2", "u2").alias("cosine")).filter(F.col("cosine") > 0)
    equal = candidates.filter("asked_1 = asked_2").withColumn("cosine", F.lit(1.0))
    matches = candidates.join(pairs, ["asked_1", "asked_2"]).select("image", "asked_1", "asked_2", "cosine").unionByName(equal.select("image", "asked_1", "asked_2", "cosine"))
    ones = sided.filter("side").select("image", F.col("asked").alias("asked_1"), F.col("question_id").alias("train_id"), F.col("dataset").alias("train_dataset"))
    others = sided.filter("NOT side").select("image", F.col("asked").alias("asked_2"), F.col("question_id").alias("eval_id"), F.col("dataset").alias("eval_dataset"), F.col("split").alias("eval_split"))
    return matches.join(others, ["image", "asked_2"]).join(ones, ["image", "asked_1"]).select("train_id", "eval_id", "eval_split", "train_dataset", "eval_dataset", "cosine")
