"""Mapping of freely written values to the entries of a canonical list.

A symmetric-delete dictionary of the list (every form with up to two characters deleted) is broadcast; a value looks up
its own deletions, so candidates within edit distance two come from hash lookups alone. They are ranked by weighted
Damerau-Levenshtein distance, then by how often the entry is used, then by term_id. What a value is compared by:
its folded writing, whole and in windows of words, so that qualifying words around a name don't matter. Every distinct
value is looked up once. Longer lists than may be broadcast are cut into blocks, and slices of the distinct values are
joined to each; the rank of a match doesn't depend on the block, so the best over all blocks is that of the whole list.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ozalid.llm.textfold import fold, typing_distance
from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage

EDITS = 2
#: Most entries of a list that is broadcast, and of a block of a longer one: some 300 deletions each make 3 million keys.
MOST_TERMS = 10_000
#: Distinct values that one task looks up in one block.
SLICE = 50_000
_WORD = re.compile(r"[^\W_]+")
_CAPITALS = re.compile(r"\b[A-Z]{2,}\b")
NOTHING = (9, 0.0, 0, 0)
_ABBREVIATION = re.compile(r"\W*\b(abbr|abbreviation|abk)\b\W*")


def deletions(text: str, edits: int = EDITS) -> set[str]:
    """text with up to `edits` (at most two) characters deleted, but never all of them."""
    out, n = {text}, len(text)
    if edits > 0 and n > 1:
        out.update([text[:i] + text[i + 1 :] for i in range(n)])
    if edits > 1 and n > 2:
        for i in range(n - 1):
            head, tail = text[:i], text[i + 1 :]
            out.update([head + tail[:j] + tail[j + 1 :] for j in range(len(tail))])
    return out


def _unleet(word: str) -> list[str]:
    """Readings of a word with digits for letters; a word without letters stays as it is."""
    if word.isdigit() or not any(c.isdigit() for c in word):
        return [word]
    word = word.replace("0", "o").replace("5", "s").replace("3", "e").replace("4", "a")
    return [word.replace("1", "l"), word.replace("1", "i")] if "1" in word else [word]


def _stem(word: str) -> str:
    for end in ("ising", "izing", "ings", "ing", "ies", "ie", "es", "e", "s", "y"):
        if word.endswith(end) and len(word) - len(end) >= 4:
            return word[: -len(end)]
    return word


@functools.lru_cache(100_000)
def _word_deletions(word: str) -> frozenset[str]:
    return frozenset(deletions(word, 2 if len(word) > 5 else 1 if len(word) > 3 else 0))


@functools.lru_cache(100_000)
def _alike(word: str, other: str) -> bool:
    """Whether two words share a deletion, or the first one's stem is one of the second's."""
    theirs = _word_deletions(other)
    return word in theirs or _stem(word) in theirs or (len(word) > 3 and not theirs.isdisjoint(deletions(word, 2 if len(word) > 5 else 1)))


Match = tuple[float, int, int]  # distance, uses below zero, term_id: the least is best


class Dictionary:
    """Lookups for one canonical list or a block of it; entries: (term_id, name, short_form).

    longest, widest: the most words and letters of a name of the whole list; those of the entries where not given.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], used: dict[int, int] | None = None, longest: int = 1, widest: int = 0):
        self.used = used or {}
        self.short: dict[str, int] = {}
        self.exact: dict[str, int] = {}
        self.sorted: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.deleted: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.longest, self.widest = longest, widest
        self.word_deletions: set[str] = set()
        self.words: dict[int, list[tuple[str, ...]]] = defaultdict(list)
        for term_id, name, short in sorted(entries, key=lambda e: (-self.used.get(e[0], 0), e[0], e[1])):
            words = name_words(name)
            if not words:
                continue
            self.longest = max(self.longest, len(words))
            if short:
                self.short.setdefault("".join(_WORD.findall(fold(short))), term_id)
            joined = "".join(words)
            if joined in self.exact:
                continue
            self.exact[joined] = term_id
            self.sorted.setdefault("".join(sorted(words)), term_id)
            self.stems.setdefault("".join(sorted(map(_stem, words))), term_id)
            self.widest = max(self.widest, len(joined))
            parts = tuple(dict.fromkeys((*words, joined)))
            self.words[term_id].append(parts)
            for word in parts:
                self.word_deletions |= _word_deletions(word)
            for form in {joined, "".join(sorted(words))}:
                for d in deletions(form):
                    self.deleted[d].append((form, term_id))

    def match(self, far: float, term_id: int) -> Match:
        return far, -self.used.get(term_id, 0), term_id

    def near(self, text: str, most: float, within: list[str] | None = None) -> Match | None:
        """The best entry within `most`; of a window of words, one that has a word like one of them."""
        if len(text) > self.widest + 5:  # more than any number of cheap insertions allows
            return None
        found = {form_term for d in deletions(text) for form_term in self.deleted.get(d, ())}
        ranked = [self.match(typing_distance(text, form, most), t) for form, t in found]
        close = sorted(r for r in ranked if r[0] <= most)
        return next((r for r in close if within is None or self._kin(within, r[2])), None)

    def _kin(self, words: list[str], term_id: int) -> bool:
        return any(_alike(w, o) for parts in self.words[term_id] for o in parts for w in words)

    def _like_a_word(self, word: str) -> bool:
        """Whether word is near a word of these entries: windows without such a word can't match."""
        if len(word) > self.widest + 5:
            return False
        if word in self.word_deletions or _stem(word) in self.word_deletions:
            return True
        return len(word) > 3 and not self.word_deletions.isdisjoint(deletions(word, 2 if len(word) > 5 else 1))

    def _whole(self, words: list[str], whole: bool) -> Match | None:
        joined, ordered = "".join(words), "".join(sorted(words))
        within = None if whole else words
        for table, form, far in ((self.exact, joined, 0.0), (self.sorted, ordered, 0.1)):
            if (t := table.get(form)) is not None and (whole or self._kin(words, t)):
                return self.match(far, t)
        stems = "".join(sorted(map(_stem, words)))
        if len(stems) >= 4 and (t := self.stems.get(stems)) is not None and (whole or self._kin(words, t)):
            return self.match(0.2, t)
        if len(joined) < 5:
            return None
        most = 3.0 if len(joined) >= 12 else 2.2 if len(joined) >= 7 else 1.0
        if not whole:  # within other words a match must be closer
            most = min(most, 0.2 * len(joined))
        hits = [h for form in dict.fromkeys((joined, ordered)) if (h := self.near(form, most, within))]
        return min(hits, default=None)

    def search(self, value: str) -> tuple[tuple[int, float, int, int], list[int]]:
        """((stage, score, uses below zero, term_id) of the entry that value means, the least is best, NOTHING if it means none;
        the entries named by abbreviations in capitals among other words).

        Stages: 0 an abbreviation alone, 1 the whole value, 2 a window of its words.
        """
        text = fold(value)
        plain = _WORD.findall(_ABBREVIATION.sub(" ", text))
        if not plain:
            return NOTHING, []
        joined = "".join(plain)
        if joined in self.short and (len(plain) == 1 or all(len(w) == 1 for w in plain)):
            return (0, *self.match(0.0, self.short[joined])), []
        readings = [plain]
        if any(c.isdigit() for c in joined):
            readings += [[_unleet(w)[0] for w in plain], [_unleet(w)[-1] for w in plain]]
        best = min((h for words in readings if (h := self._whole(words, True))), default=None)
        if best:
            return (1, *best), []
        windows = []
        for words in readings:
            likely = [self._like_a_word(w) for w in words]
            for n in range(min(self.longest + 1, len(words) - 1), 0, -1):
                for i in range(len(words) - n + 1):
                    part = words[i : i + n]
                    if any(likely[i : i + n]) and (h := self._whole(part, False)):
                        windows.append((h[0] - 0.5 * sum(map(len, part)), *h[1:]))
        if windows:
            return (2, *min(windows)), []
        return NOTHING, sorted({self.short[w] for w in map(str.lower, _CAPITALS.findall(value)) if w in self.short})

    def lookup(self, value: str) -> int:
        """The term_id that value means, 0 if it means none."""
        best, named = self.search(value)
        return best[3] if best[0] < 9 else named[0] if len(named) == 1 else 0


def name_words(name: str) -> list[str]:
    return _WORD.findall(fold(name))


def use_counts(df: DataFrame, columns: list[str], terms: DataFrame) -> DataFrame:
    """(term_id, used): how often each entry's name stands, as written, in the columns of df."""
    values = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return terms.filter("name IS NOT NULL").join(values, "name", "left").groupBy("term_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"))


def map_values(df: DataFrame, value: str, terms: DataFrame, out: str = "term_id", used: DataFrame | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """df with `out`, the term_id meant by df[value]: 0 for values that mean no entry, NULL for null or blank ones.

    terms: term_id, name, short_form (rows without name or id are left out; of names written alike the most used one, then
    the smallest id counts; an empty list maps every value to 0). used: use_counts, which break ties between entries at
    the same distance. Distinct values are looked up once and joined back, hot ones apart; all other columns, whatever
    their names, pass through. A list of more than most_terms entries is joined in blocks of about that size, of which a
    task holds one: the results are the same.
    """
    spark = df.sparkSession
    named = terms.filter("name IS NOT NULL AND term_id IS NOT NULL").select("term_id", "name", "short_form")
    named = named.join(used.select("term_id", "used"), "term_id", "left") if used is not None else named.withColumn("used", F.lit(0))
    named = named.withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    rest = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*[F.col(c) for c in rest]).alias("_row"), F.col(value).alias("_value"))
    filled = F.coalesce(F.col("_value").rlike(r"\S"), F.lit(False))
    values = cut_lineage(rows.filter(filled).groupBy("_value").agg(F.count("*").alias("_rows")))
    if named.count() <= most_terms:
        found = _looked_up(spark, values, named.collect())
    else:
        found = _joined(values, named, most_terms)
    total = values.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    mapped = join_by_share(rows.filter(filled), cut_lineage(found), "_value", "_rows", total)
    none = rows.filter(~filled).withColumn("_id", F.lit(None).cast("long"))
    both = mapped.select("_row", "_id").unionByName(none.select("_row", "_id"))
    return both.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_id").alias(out))


def _looked_up(spark, values: DataFrame, rows) -> DataFrame:
    shared = spark.sparkContext.broadcast(([(r[0], r[1], r[2]) for r in rows], {r[0]: r[3] for r in rows}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = Dictionary(*shared.value)
        for pdf in batches:
            yield pdf.assign(_id=pd.array([dictionary.lookup(v) if v.strip() else None for v in pdf["_value"].array], "Int64"))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows, much work each
    return values.repartition(parts, F.xxhash64("_value")).mapInPandas(run, "_value string, _rows long, _id long")


def _joined(values: DataFrame, named: DataFrame, most_terms: int) -> DataFrame:
    """values with _id from a list of any length: every slice of the values meets every block of the list."""
    blocks = -(-named.count() // most_terms)
    slices = -(-max(1, values.count()) // SLICE)

    @F.pandas_udf("words int, letters int")
    def extent(names: pd.Series) -> pd.DataFrame:
        split = [name_words(n) for n in names.array]
        return pd.DataFrame({"words": [len(w) for w in split], "letters": [sum(map(len, w)) for w in split]})

    longest, widest = named.select(extent("name").alias("x")).agg(F.max("x.words"), F.max("x.letters")).first()
    block = named.withColumn("_block", F.pmod(F.xxhash64("name"), F.lit(blocks).cast("long")))
    block = block.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    cut = values.select("_value", F.pmod(F.xxhash64("_value"), F.lit(slices)).cast("int").alias("_slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))

    def run(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        entries = list(zip(theirs["term_id"], theirs["name"], theirs["short_form"].where(theirs["short_form"].notna(), None), strict=True))
        dictionary = Dictionary(entries, dict(zip(theirs["term_id"], theirs["used"], strict=True)), longest, widest)
        found = [(v, *dictionary.search(v)) for v in mine["_value"].array if v.strip()]
        return pd.DataFrame([(v, *best, named) for v, best, named in found], columns=["_value", "stage", "score", "uses", "id", "named"])

    hits = cut.groupBy("_slice", "_block").cogroup(block.groupBy("_slice", "_block")).applyInPandas(run, "_value string, stage int, score double, uses long, id long, named array<long>")
    best = hits.groupBy("_value").agg(F.min(F.struct("stage", "score", "uses", "id")).alias("best"), F.array_distinct(F.flatten(F.collect_list("named"))).alias("named"))
    meant = F.when(F.col("best.stage") < 9, F.col("best.id")).when(F.size("named") == 1, F.get("named", F.lit(0))).otherwise(F.lit(0))
    return values.join(best.select("_value", meant.alias("_id")), "_value", "left")
