"""Texts that stop before their own end: a self-join by prefix.

The values that are joined are the units of texts (sentences and lines), with numbers written as 0; every distinct unit
counts as often as it stands, and the unit in which a text ends, its tail, is what may be cut. A cut tail is a strict
prefix of longer copies elsewhere. As tails differ in names and in what is filled in, prefixes are hashed in fixed
lengths: every prefix of every unit by its last one, two, three, four and six tokens (a short prefix is whole then, with
the unit's beginning) and with the first two tokens of its clause. Joined to the hashed tails, they say in how many
units the same words go on, in how many they end, and name a longer copy. The chance of an end given the tail is
estimated from the shortest prefix to the longest, each text leaving itself and its near copies out; where it is as
small as a random cut's and there is a longer copy, the text was cut. A last word that is a strict prefix of longer words
in its place, and hardly stands there itself, was cut as well.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage

#: A word is known if it makes up this share of all tokens inside texts, at any size of the corpus: at most 1/KNOWN_SHARE
#: words are broadcast. Others (names, misspellings) are told apart by their class alone.
KNOWN_SHARE = 2e-6
#: Slots for each hash of a tail in the bitmap that keeps other prefixes out of the shuffle, and the most slots (8 MB). More
#: hashes than that make it let more through: that costs shuffle, and changes no result.
SLOTS_EACH, MOST_SLOTS = 16, 1 << 26
#: Weight of the shorter windows' estimate, in occurrences.
PRIOR = 8.0
#: Below this chance that a clause ends here, that a text or line ends after such a mark, or this share of like units that
#: end without a mark, the tail counts as cut.
LEAST_END, LEAST_MARK, LEAST_STYLE = 0.05, 0.004, 0.12

#: A last word counts as a part if longer words that begin with it stand so many times as often after the word before it.
LONGER = 8
#: Texts whose last so many tokens are equal but for numbers, names and white space are near copies: they end where they do
#: for one reason, and are no evidence for each other.
COPY = 12
#: Most tokens that a worker keeps, some 100 bytes each.
KEPT = 500_000
#: Longest part of a word that is looked up among longer words.
PART = 12

_TOKEN = re.compile(r"[A-Za-z]++(?![^\W_])|\n+| - |[0-9]+(?:[.,:/][0-9]+)*(?![A-Za-z0-9])|[A-Za-z]*[0-9][A-Za-z0-9]*|[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+|\S")
_DIGITS = frozenset("0123456789")
#: A mark that says by itself that something is missing: a broken character, or dots in brackets; within the last OMITTED_IN
#: characters.
OMITTED, OMITTED_IN = r"(?:\uFFFD|[\[(]\s{0,8}(?:\.{2,8}|\u2026)\s{0,8}[\])])$", 30
_BLANKS = " \t\n\r\f\x0b\xa0\u2026\ufffd"
#: Dots or one word in brackets at the end: no part of the text.
_BRACKETED = r"[\[(]\s*+(?:\.{2,}+|\u2026|\p{L}{1,12}+)\s*+[\])]$"
#: Stands between units while a text is split.
_CUT = "\x01"
_BREAKS = frozenset((".", "?", "!", ";", ",", ":", "。", "，", "；", "：", "？", "！", " - ", "|", "\n"))
LEVELS = 7
PAD, LINE = 1, 5  # the numbers of no token and of a line break
_PAD = [PAD] * 6


def with_bare(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, df[text] without white space and up to two marks of omission at its end; each step is computed once."""
    df = df.withColumn(out, F.rtrim(F.col(text), F.lit(_BLANKS)))
    at = F.col(out)
    for _ in range(2):
        df = df.withColumn(out, F.when(at.endswith(".."), F.rtrim(at, F.lit("." + _BLANKS))).otherwise(at))
        closed = at.endswith("]") | at.endswith(")")
        df = df.withColumn(out, F.when(closed, F.rtrim(F.regexp_replace(at, _BRACKETED, ""), F.lit(_BLANKS))).otherwise(at))
    return df


def units(text: Column) -> Column:
    """The sentences and lines of text, numbers as 0, runs of blanks as one; a line's last unit keeps its line break."""
    plain = F.regexp_replace(text, r"[0-9]++(?:[.,:/][0-9]++)*+", "0")
    blank = r"[\s\x00-\x1F&&[^\n]]"
    plain = F.regexp_replace(plain, rf"(?U)(?:{blank}{{2,}}+|[\s\x00-\x1F&&[^\n ]])", " ")
    plain = F.regexp_replace(plain, r" ?\n[ \n]*+", "\n")
    for mark in ".?!":
        plain = F.replace(plain, F.lit(mark + " "), F.lit(mark + _CUT))
    for mark in "\u3002\uff1f\uff01\n":
        plain = F.replace(plain, F.lit(mark), F.lit(mark + _CUT))
    split = F.split(F.replace(plain, F.lit(_CUT + "\n"), F.lit("\n")), _CUT)
    return F.filter(split, lambda u: ~u.isin("", " ", "\n"))


class _Tokens(dict):
    """What each token counts as, once for each that a worker meets."""

    def __missing__(self, t: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        if t[-1] in _DIGITS or t[0] in _DIGITS or (t[0] < "\x7f" and not t.isalpha() and t.isalnum()):
            self[t] = "X0" if any(c.isalpha() for c in t) else "0"
        else:
            self[t] = "\n" if t[0] == "\n" else t
        return self[t]


_MEANT = _Tokens()


def tokens(text: str) -> list[str]:
    """Words, single ideographs, numbers as 0, names with digits as X0, line breaks and other characters."""
    return [_MEANT[t] for t in _TOKEN.findall(text)]


def part_hash(part: str) -> int:
    data = part.encode()
    return zlib.crc32(data) << 32 | zlib.adler32(data)


def copy_class(split: list[str]) -> int:
    """A hash of the last COPY tokens with numbers and runs of capitalised words as one token each."""
    out: list[str] = []
    for t in reversed(split):
        t = "X" if t == "X0" or (t[0].isupper() and len(t) > 1) else t
        if t != "X" or not out or out[-1] != "X":
            if len(out) == COPY:
                break
            out.append(t)
    return int.from_bytes(hashlib.blake2b(" ".join(out).encode(), digest_size=8).digest(), "big", signed=True)


class _Numbers(dict):
    """The numbers of known words; others get that of their class."""

    def __missing__(self, token: str) -> int:
        if token == "\n":
            return LINE
        if not token[0].isalpha():
            return 2
        return 3 if token[0].isupper() and len(token) > 1 else 4


class Vocabulary:
    """Numbers for known words; unknown ones by class: capitalised, with digits around, other."""

    def __init__(self, words: list[str]):
        self._parts: np.ndarray | None = None
        self.sorted = sorted(w for w in words if w != "\n")
        self.ids = _Numbers((w, i + 16) for i, w in enumerate(self.sorted))
        self.breaks = np.zeros(len(self.sorted) + 16, bool)
        self.closes, self.ends = self.breaks.copy(), self.breaks.copy()
        self.breaks[LINE] = self.ends[LINE] = True
        for table, marks in ((self.breaks, _BREAKS), (self.ends, _CLOSERS)):
            for b in marks:
                if b in self.ids:
                    table[self.ids[b]] = True
        for w, i in self.ids.items():  # closing marks, smileys, symbols
            self.closes[i] = not w[0].isalnum() and w[0] not in "([{<'’\"-/=#*%|_ &+~@$"

    def parts(self) -> np.ndarray:
        """Hashes of the strict prefixes of every known word, up to PART characters; 0 where a word is no longer."""
        if self._parts is None:
            self._parts = np.zeros((len(self.sorted) + 16, PART), np.uint64)
            for w, i in self.ids.items():
                if w[0].isalpha():
                    for k in range(1, min(len(w), PART + 1)):
                        self._parts[i, k - 1] = part_hash(w[:k])
        return self._parts

    def starts_known(self, word: str) -> bool:
        """Whether word is a strict prefix of a known word."""
        k = bisect_left(self.sorted, word)
        if k < len(self.sorted) and self.sorted[k] == word:
            k += 1
        return k < len(self.sorted) and self.sorted[k].startswith(word)


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


_CLOSERS, _WITHIN_NUMBERS = frozenset(".?!。？！"), frozenset(".:/")


class Corpus:
    """Positions of a batch of tokenised units: flat token numbers, padded before each unit. final: whether a text ends with
    the unit."""

    def __init__(self, units: list[list[str]], vocabulary: Vocabulary, final: list[bool] | None = None):
        ids = vocabulary.ids
        numbers = [[ids[t] for t in tokens] for tokens in units]
        self.flat = flat = np.array([x for n in numbers for x in (*_PAD, *n)] + [PAD], np.int64)
        inside = flat != PAD
        self.inside = inside
        nothing = np.zeros(len(flat), bool)
        self.last = nothing.copy()
        self.last[:-1] = inside[:-1] & ~inside[1:]
        self.unit = np.repeat(np.arange(len(units)), [len(n) + len(_PAD) for n in numbers])
        self.unit = np.append(self.unit, max(0, len(units) - 1))
        if final is not None:
            self.last &= np.array(final, bool)[self.unit] if units else False
        known = np.minimum(flat, len(vocabulary.breaks) - 1)
        breaks, closes = vocabulary.breaks[known] & inside, vocabulary.closes[known] & inside
        self.e1, self.e2 = self.last.copy(), self.last.copy()  # a text or line ends next; a text, line, clause or sentence does
        self.e1[:-1] |= flat[1:] == LINE
        self.e2[:-1] |= breaks[1:] | closes[1:]
        place = np.arange(len(flat))

        def start(stops: np.ndarray) -> np.ndarray:
            begins = nothing.copy()
            begins[1:] = (stops[:-1] | ~inside[:-1]) & inside[1:] & ~stops[1:]
            return np.maximum.accumulate(np.where(begins | ~inside, place, 0))

        lines = (flat == LINE) | vocabulary.ends[known] & inside
        self.clause, self.sentence = start(breaks), start(lines)
        self.closing = self.last.copy()  # the last token of a clause
        self.closing[:-1] |= (breaks[1:] | closes[1:]) & inside[:-1] & ~breaks[:-1] & ~closes[:-1]
        self.good = self.last.copy()  # closed without a mark
        self.good[:-1] |= (flat[1:] == LINE) | (flat[1:] == vocabulary.ids.get(" - ", -1))

    def two(self, at: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
        """The first two tokens of the unit that starts at `at`."""
        return [self.flat[at], np.where(at + 1 <= upto, self.flat[np.minimum(at + 1, len(self.flat) - 1)], 0)]

    def windows(self, where: np.ndarray) -> np.ndarray:
        """Hashes of the LEVELS windows that end at each position in `where`, one row per level, from general to special:
        the last token; the clause's first two tokens and the last; the last two; the clause's first two and the last
        two; the last three, four and six."""
        back = [self.flat[where - k] for k in range(6)]  # the padding before a text keeps this inside
        unit = self.two(self.clause[where], where)
        parts = ([back[0]], [back[0], *unit], back[:2], [*back[:2], *unit], back[:3], back[:4], back)
        return np.array([_hash(level, columns) for level, columns in enumerate(parts)])

    def longer(self, where: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Hashes of (token before, strict prefix) for every prefix of the word at each position; 0 for none."""
        before, prefixes = self.flat[where - 1], parts[np.minimum(self.flat[where], len(parts) - 1)]
        h = _mix(_hash(LEVELS + 2, [before]).view(np.uint64)[:, None], prefixes)
        return np.where(prefixes == 0, np.uint64(0), h).view(np.int64).ravel()

    def last_parts(self, where: np.ndarray, words: list[str]) -> np.ndarray:
        """The hash under which `longer` has the words that begin with the last one; 0 where it isn't such a word."""
        parts = np.array([part_hash(w) if w[0].isalpha() and len(w) <= PART else 0 for w in words], np.uint64)
        h = _mix(_hash(LEVELS + 2, [self.flat[where - 1]]).view(np.uint64), parts)
        return np.where(parts == 0, np.uint64(0), h).view(np.int64)

    def styles(self, where: np.ndarray) -> np.ndarray:
        """Hashes of the clause's and the sentence's first two tokens at each position in `where`."""
        return np.array([_hash(LEVELS + k, self.two(at[where], where)) for k, at in enumerate((self.clause, self.sentence))])


def _hash(level: int, columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), level + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for c in columns:
        h = _mix(h, c)
    return h.view(np.int64)


def chance(seen: list[tuple[int, int]], base: float) -> float:
    """From (occurrences, events) of each level, general to special, without the text's own. A level that has the same
    occurrences as the one before, as all levels have beyond a unit's beginning, says nothing new."""
    p, last = base, None
    for n, e in seen:
        if (n, e) != last:
            p = (max(0, e) + PRIOR * p) / (max(0, n) + PRIOR)
        last = n, e
    return p


def judge(kind: str, levels: list[tuple[int, int, int]], styles: list[tuple[int, int]], base: tuple[float, float], longer: int = 0) -> tuple[bool, float, float]:
    """(cut, chance of an end, share of such units that end without a mark) of a tail of `kind`.

    levels: (occurrences, e1, e2) with the text's own occurrence, but not its near copies'; styles: (units, units closed without a mark), likewise.
    longer: how often a longer word that begins with the last one stands after the word before it.
    """
    if kind == "part" or (kind == "word" and longer >= LONGER * levels[2][0]):
        return True, 0.0, 0.0
    if kind == "mark":
        p = chance([(n - 1, e1 - 1) for n, e1, _ in levels], base[0])
        return p < LEAST_MARK, p, 1.0
    p = chance([(n - 1, e2 - 1) for n, _, e2 in levels], base[1])
    if kind == "number":
        return p < LEAST_END / 2, p, 1.0
    style = max((g - 1 + 0.15) / n for n, g in styles)
    return p < LEAST_END or style < LEAST_STYLE, p, style


def tail_kind(tokens: list[str], vocabulary: Vocabulary) -> str:
    """part: a word that only begins a known one; whole: ends in a sentence mark; number: a number before what may stand within it;
    mark: another character; word: all else."""
    t = tokens[-1]
    if t in _WITHIN_NUMBERS and len(tokens) > 1 and tokens[-2] in ("0", "X0"):
        return "number"
    if t in _CLOSERS:
        return "whole"
    if not t[0].isalnum():
        return "mark"
    return "part" if t[0].isalpha() and t not in vocabulary.ids and vocabulary.starts_known(t) else "word"


# -- the distributed steps -------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pd.DataFrame], column: str, characters: int = 500_000) -> Iterator[pd.DataFrame]:
    """Rows in runs of about so many characters: what is held at once doesn't depend on the batch size."""
    for pdf in batches:
        sizes = pdf[column].str.len().cumsum().to_numpy() // characters
        for _, part in pdf.groupby(sizes, sort=False):
            yield part


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        frame = pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
        counts.clear()
        return frame

    for pdf in batches:
        for unit, final, n in zip(pdf["unit"].array, pdf["final"].array, pdf["n"].array, strict=True):
            words = tokens(unit)
            if final:
                words.pop()
            if n == 1:
                counts.update(words)
            else:
                for w in words:
                    counts[w] += n
            if len(counts) > 200_000:
                yield out()
    yield out()


def _tails(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(shared.value)
        for pdf in _chunks(batches, "unit"):
            split = [tokens(s) or ["."] for s in pdf["unit"].array]
            kinds = [tail_kind(t, v) for t in split]
            c = Corpus(split, v)
            at = np.flatnonzero(c.last) - np.array([k == "number" for k in kinds], np.int64)
            last = [t[-1] if k in ("word", "part") else "0" for t, k in zip(split, kinds, strict=True)]
            hashes = np.concatenate([c.windows(at), c.styles(at), c.last_parts(at, last)[None, :]]).T
            copies = [copy_class([*tokens(before), *t]) for before, t in zip(pdf["before"].array, split, strict=True)]
            part = [t[-1] if k == "part" else None for t, k in zip(split, kinds, strict=True)]
            yield pd.DataFrame({"key": pdf["key"].to_numpy(), "kind": kinds, "part": part, "copy": copies, "h": list(hashes)})

    return run


_NONE = np.iinfo(np.int64).min


def _window_counts(shared, bitmap):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, bits = Vocabulary(shared.value), bitmap.value
        slots = np.uint64(64 * len(bits))
        for pdf in _chunks(batches, "unit"):
            c = Corpus([tokens(s) for s in pdf["unit"].array], v, pdf["final"].tolist())
            times, ids = pdf["n"].to_numpy()[c.unit], pdf["id"].to_numpy()[c.unit]
            where, closing = np.flatnonzero(c.inside), np.flatnonzero(c.closing)
            longer = c.longer(where, v.parts())
            inner = np.repeat(where, PART)[longer != 0]
            longer = longer[longer != 0]
            at = np.concatenate([*[where] * LEVELS, *[closing] * 2, inner])
            h = np.concatenate([*c.windows(where), *c.styles(closing), longer])
            no = np.zeros(2 * len(closing) + len(longer), bool)
            e1 = np.concatenate([*[c.e1[where]] * LEVELS, *[c.good[closing]] * 2, no[: len(longer)]])
            e2 = np.concatenate([*[c.e2[where]] * LEVELS, no])
            # where a prefix goes on; units that only begin alike are longer copies of a tail if they are whole
            whole_units = ~np.append(pdf["final"].to_numpy(bool), True)[c.unit[closing]]
            goes = np.concatenate([*[~c.e2[where]] * LEVELS, whole_units, whole_units, ~no[: len(longer)]])
            slot = h.view(np.uint64) % slots
            wanted = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            h, e1, e2, at, goes = h[wanted], e1[wanted], e2[wanted], at[wanted], goes[wanted]
            unique, back = np.unique(h, return_inverse=True)

            def total(weights, back=back, size=len(unique)) -> np.ndarray:
                return np.bincount(back, weights=weights, minlength=size).astype(np.int64)

            n = times[at]
            on = np.full(len(unique), _NONE)
            on[back[goes]] = ids[at[goes]]
            whole = [int(x.sum()) for x in (times[where], c.e1[where] * times[where], c.e2[where] * times[where])]
            yield pd.DataFrame({"h": np.append(unique, 0), "n": np.append(total(n), whole[0]), "e1": np.append(total(e1 * n), whole[1]), "e2": np.append(total(e2 * n), whole[2]), "on": np.append(on, _NONE)})

    return run


def _bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits of the hashes of tails, in words of 64 bits."""
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(16, (SLOTS_EACH * count).bit_length()))
    slot = F.pmod(F.col("h"), F.lit(slots).cast("long"))  # 2**64 is a multiple of slots, so this is the unsigned remainder
    packed = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(slots // 64, np.uint64)
    bits[packed["w"].to_numpy()] = packed["b"].to_numpy().view(np.uint64)
    return bits


def truncated(df: DataFrame, text: str, keep: list[str], evidence: bool = False) -> DataFrame:
    """The columns `keep` of the rows of df whose text was cut; with evidence, also `tail`, the text's last unit, and
    `longer`, a unit elsewhere that goes on where the tail stops (NULL where a mark of omission alone says so).

    NULL, empty and blank texts, and texts of marks alone, are none. Equal texts get equal answers and count once in the
    statistics, which run over the whole texts of all rows; near copies of a text are left out when it is judged. An empty
    table gives an empty result. A corpus in which nothing recurs has no longer copies, so only broken characters and dots
    in brackets count there.
    """
    spark = df.sparkSession
    given = df.select(*keep, F.col(text).alias("_text")).filter("_text IS NOT NULL").withColumn("key", F.md5("_text"))
    # no filter before the texts are written: it would be pushed down and compute their units twice
    distinct_texts = given.select("key", F.col("_text").alias("s")).groupBy("key", "s").agg(F.count("*").alias("copies"))
    texts = with_bare(distinct_texts, "s", "s").withColumn("units", units(F.col("s")))
    size = F.size("units")
    before = F.array_join(F.slice("units", F.greatest(F.lit(1), size - 3), F.greatest(F.lit(0), F.least(F.lit(3), size - 1))), " ")
    texts = texts.select("key", "copies", F.slice("units", F.lit(1), F.greatest(F.lit(0), size - 1)).alias("inner"), F.get("units", size - 1).alias("unit"), before.alias("before"))
    texts = cut_lineage(texts).filter("unit IS NOT NULL")
    each = texts.select(F.explode("inner").alias("unit"), F.lit(False).alias("final")).unionByName(texts.select("unit", F.lit(True).alias("final")))
    distinct = cut_lineage(each.groupBy("unit", "final").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("unit")))
    words = cut_lineage(distinct.mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = [r["word"] for r in words.filter(F.col("n") >= max(2, KNOWN_SHARE * total)).select("word").collect()]
    shared = spark.sparkContext.broadcast(sorted(known))
    tails = cut_lineage(texts.select("key", "unit", "before").mapInPandas(_tails(shared), "key string, kind string, part string, copy long, h array<long>"))
    # what begins a known word but stands inside texts itself, though rarely, is a word
    seldom = tails.filter("part IS NOT NULL").select("key", F.col("part").alias("word")).join(words.filter("n > 1"), "word", "left_semi").select("key", F.lit("word").alias("stands"))
    tails = cut_lineage(tails.join(seldom, "key", "left").select("key", F.coalesce("stands", "kind").alias("kind"), "copy", "h"))
    open_tails = tails.filter("kind <> 'whole'")
    hashes = open_tails.select("key", "copy", F.posexplode("h").alias("level", "h")).filter("h <> 0").withColumn("own", F.xxhash64("copy", "h"))
    classes = cut_lineage(hashes.groupBy("own", "h").agg(F.count("*").alias("tails")))
    tails_total, classes_total = classes.agg(F.coalesce(F.sum("tails"), F.lit(0)), F.count("*")).first()
    bits = spark.sparkContext.broadcast(_bitmap(classes, classes_total))
    found = distinct.mapInPandas(_window_counts(shared, bits), "h long, n long, e1 long, e2 long, on long")
    counts = cut_lineage(found.groupBy("h").agg(F.sum("n").alias("n"), F.sum("e1").alias("e1"), F.sum("e2").alias("e2"), F.max("on").alias("on")))
    row = counts.filter("h = 0").first()
    rates = (row["e1"] / row["n"], row["e2"] / row["n"]) if row and row["n"] else (0.0, 0.0)
    # one row per prefix and class of near copies: its counts without those of the other tails of the class
    used = classes.groupBy("h").agg(F.count("*").alias("classes"))
    table = cut_lineage(used.join(counts, "h"))
    each_class = join_by_share(classes, table, "h", "classes", classes_total)
    other = F.when(F.col("level") == LEVELS + 2, 0).otherwise(F.col("tails") - 1)  # longer words are never tails themselves
    met = join_by_share(hashes.select("key", "level", "own"), each_class.select("own", F.col("tails").alias("rows"), "tails", "n", "e1", "e2", "on"), "own", "rows", tails_total)
    met = met.select("key", "level", *[(F.col(c) - other).alias(c) for c in ("n", "e1", "e2")], "on")
    # one token alone makes no copy
    longest = F.max(F.when((F.col("on") != int(_NONE)) & (F.col("level") > 0), F.struct("level", "on"))).alias("longest")
    met = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("level", "n", "e1", "e2"))).alias("seen"), longest)

    @F.pandas_udf("boolean")
    def is_cut(kinds: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for kind, rows in zip(kinds.array, seen.array, strict=True):
            got = {r["level"]: r for r in rows}
            levels = [(r["n"], r["e1"], r["e2"]) if (r := got.get(i)) else (1, 1, 1) for i in range(LEVELS)]
            styles = [(r["n"], r["e1"]) if (r := got.get(LEVELS + k)) else (1, 1) for k in range(2)]
            longer = got[LEVELS + 2]["n"] if LEVELS + 2 in got else 0
            out.append(judge(kind, levels, styles, rates, longer)[0])
        return pd.Series(out)

    judged = open_tails.select("key", "kind").join(met, "key").select("key", F.col("longest.on").alias("on"), (is_cut("kind", "seen") & F.col("longest.on").isNotNull()).alias("cut"))
    verdict = tails.select("key", "kind").join(judged, "key", "left").join(texts.select("key", "copies", "unit"), "key")
    # a mark of omission after an unfinished text is evidence of its own row; the texts before the mark may be equal
    verdict = verdict.select("key", "copies", "unit", "on", F.coalesce("cut", F.lit(False)).alias("cut"), (F.col("kind") != "whole").alias("open")).filter("cut OR open")
    if not evidence:
        verdict = verdict.drop("unit", "on")
    all_rows = texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    ending = F.right(F.rtrim(F.col("_text"), F.lit(" \t\n\r\f\x0b\xa0")), F.lit(OMITTED_IN))
    rows = given.select(*keep, "key", ending.rlike(OMITTED).alias("_omitted"))
    cut = join_by_share(rows, verdict, "key", "copies", all_rows).filter("cut OR (open AND _omitted)")
    if not evidence:
        return cut.select(*keep)
    named = distinct.groupBy(F.col("id").alias("on")).agg(F.max("unit").alias("longer"))
    some = cut.groupBy("on").agg(F.count("*").alias("rows")).join(named, "on")
    told = cut.select(*keep, F.col("unit").alias("tail"), "on")
    count = told.count()
    with_longer = join_by_share(told, some, "on", "rows", count)
    return with_longer.select(*keep, "tail", "longer").unionByName(told.join(some.select("on"), "on", "left_anti").select(*keep, "tail", F.lit(None).cast("string").alias("longer")))
