"""Text decoded in the wrong encoding: found and, where it can be known, restored.

The words of the corpus that make up a fixed share of it are the language model. Noisy-channel decoding of a doubtful
word: for every encoding it may have been read in (the channel), each of its characters becomes the bytes it was read
from, with alternatives for what was done to it since (changed case, lost or replaced bytes); for every encoding that
may have been right, this byte lattice is searched by Viterbi along the trie of the model's words in that encoding.
A path costs what its channel, its repairs and the rarity of its word cost. A word is garbled if such a path ends in
a known word that is more frequent than the word as it stands. Words below that share are searched in the same way, in
blocks of those whose ASCII bytes a path can give.

UTF-8 needs no frequencies: text hardly ever spells valid UTF-8 in another encoding unless it was UTF-8, so such a word
is garbled however often it stands.
"""

from __future__ import annotations

import functools
import html
import itertools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage

#: A word belongs to the language model if it makes up this share of all words, so at most 1/MODEL_SHARE words are broadcast.
#: The others are searched by their ASCII bytes, in blocks.
MODEL_SHARE = 1e-5
# Encodings, right ones and those that text is wrongly read in, likely ones first.
RIGHT = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "iso8859-2", "koi8-r", "cp866", "gb18030", "cp932", "euc_jp", "big5", "mac-roman", "cp437", "cp850")
WRONG = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "iso8859-15", "gb18030", "big5", "cp932", "euc_kr", "euc_jp")
#: Costs in nats: a channel, a character whose case was changed, a lost byte, a replaced character, a byte that stands for itself.
CHANNEL, CASE, LOST, REPLACED = 3.0, 0.5, 4.0, 1.5
#: How often the restored word must stand for each time the word itself does, unless the word is UTF-8 read wrongly.
ODDS = 4
#: Characters of a word from which distinct values alone decide: signs and single letters become others in any encoding.
LEAST_LENGTH = 3
#: Bytes that may be lost in a word, besides those of lost characters, and bytes of the longest character: what counts as damage.
MOST_LOST, LONGEST = 2, 4
#: Words below the model's share are searched in blocks of this size, each for as many words; equal answers for any size.
BLOCK = 3000
#: Most forms of a word's ASCII bytes that are looked up; a word with more is looked up by those that no wide encoding moves.
MOST_KEYS = 64
#: Most words and arcs that a worker keeps, some 200 bytes each; then it starts anew.
KEPT = 500_000
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{2,}-?")
_NUMBER = re.compile(r"[0-9]+")
CODED = r"&[#A-Za-z0-9]+;|\+[A-Za-z0-9+/]{2,}"
_CODED = re.compile(CODED)
#: What a clean value never needs: broken characters and C1 controls.
BROKEN = r"[\uFFFD\x{80}-\x{84}\x{86}-\x{9F}]"
DOUBTFUL = r"[^\x00-\x7F]|&[#A-Za-z0-9]+;|\+[A-Za-z0-9+/]{2,}|\?[^\s?!.\"')]"


def shape(word: str) -> str:
    """word with runs of digits as 9: what the model counts. Digits of entities and UTF-7 stay, they spell letters."""
    return word if _CODED.search(word) else _NUMBER.sub("9", word)


def _byte_table(name: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes that it leaves undefined are read as C1 controls, as programs do."""
    out = {}
    for b in range(256):
        try:
            c = bytes((b,)).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


def _wide(name: str) -> bool:
    return name in ("gb18030", "big5", "cp932", "euc_kr", "euc_jp", "utf-8")


_ASIAN = frozenset(("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH", "BOPOMOFO"))
#: Characters of Western text beyond ASCII: Latin and Greek letters, punctuation, signs.
_USUAL = re.compile("[\u00a0-\u017f\u0218-\u021b\u0391-\u03c9\u2010-\u2044\u2070-\u209f\u20ac\u2122\u2190-\u22ff\ufb00-\ufb04]*")
#: Non-ASCII characters within a word or after a small letter: no closing quote behind a capital.
_WITHIN = re.compile(r"[a-z][^\x00-\x7F]|[^\x00-\x7F][A-Za-z]")
_TABLES: dict[str, dict[str, int]] = {}


def _bytes(text: str, wrong: str) -> bytes | None:
    """The bytes that give text when read in `wrong`, or None if none do."""
    if _wide(wrong):
        try:
            return text.encode(wrong)
        except UnicodeEncodeError:
            return None
    if wrong not in _TABLES:
        _TABLES[wrong] = _byte_table(wrong)
    out = [_TABLES[wrong].get(c) for c in text]
    return None if None in out else bytes(out)


def as_utf8(word: str) -> tuple[str, bool] | None:
    """(text, sure) if all of word is UTF-8 that was read in another encoding, and nothing of it was lost.

    Not sure: a single character that stands alone or ends a word in capitals ('Её' in windows-1251, 'MÃ”'), or few
    characters that are unusual. None: no such text.
    """
    if word.isascii() or "\ufffd" in word:
        return None
    best = None
    for wrong in WRONG:
        if (data := _bytes(word, wrong)) is None:
            continue
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text == word or any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in text):
            continue
        if text[0] == "\ufeff":
            return text[1:] or text, True
        if (sure := _sure(word, text, _wide(wrong))) or best is None:
            best = text, sure
        if sure:
            break
    return best


def _sure(word: str, text: str, wide: bool) -> bool:
    other = [c for c in text if not c.isascii()]
    letters = [c for c in other if c.isalpha()]
    scripts = {unicodedata.name(c, "").split(" ")[0] for c in letters}
    asian = bool(scripts) and scripts <= _ASIAN
    if asian:
        return len(letters) >= 2
    if wide and scripts <= {"LATIN"}:
        return bool(_USUAL.fullmatch("".join(other)) and re.search("[A-Za-z]", word))
    return (len(letters) >= 3 and len(scripts) == 1) or bool(not wide and _USUAL.fullmatch("".join(other)) and _WITHIN.search(word))


def candidates(word: str) -> list[str]:
    """All that word may have been, if nothing of it was lost: read in any encoding, or coded, in any number of rounds. What
    such a form is worth only the words of the corpus can tell. Forms of few characters are left to the model."""
    out: set[str] = set()
    for rank, text in enumerate(_undone(word)):
        forms = {text} if rank else set()
        if not text.isascii() and "\ufffd" not in text:
            for wrong in WRONG:
                if (data := _bytes(text, wrong)) is None:
                    continue
                for right in RIGHT:
                    if right != wrong:
                        try:
                            forms.add(data.decode(right))
                        except UnicodeDecodeError:
                            continue
        for f in forms:
            wide = sum(not c.isascii() for c in f)
            if (wide >= 2 or (wide and len(f) >= LEAST_LENGTH)) and f.lower() not in (word.lower(), text.lower() if rank == 0 else "") and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in f):
                out.add(shape(f))
    return sorted(out)


_ARCS: dict[tuple[str, str, str], tuple[tuple[bytes | None, float, bool], ...]] = {}


def char_arcs(char: str, wrong: str, right: str) -> tuple[tuple[bytes | None, float, bool], ...]:
    """_arcs, once for each character and pair of encodings."""
    key = (char, wrong, right)
    if (found := _ARCS.get(key)) is None:
        if len(_ARCS) >= KEPT:
            _ARCS.clear()
        found = _ARCS[key] = _arcs(char, wrong, right)
    return found


def _arcs(char: str, wrong: str, right: str) -> tuple[tuple[bytes | None, float, bool], ...]:
    """(bytes, cost, garbled) of one character; bytes None: any bytes of one lost character."""
    try:
        out = [(char.encode(right), 0.0, False)]  # it may stand for itself
    except UnicodeEncodeError:
        out = []
    if char.isascii():
        return (*out, (None, REPLACED, True)) if char == "?" else tuple(out)
    if char == "�":
        return ((None, REPLACED, True),)
    forms = [(char, 0.0)]
    for other in (char.upper(), char.lower()):
        if other != char and len(other) == 1:
            forms.append((other, CASE))
    for form, cost in forms:
        if not _wide(wrong):
            if wrong not in _TABLES:
                _TABLES[wrong] = _byte_table(wrong)
            b = _TABLES[wrong].get(form)
            data = bytes((b,)) if b is not None and b >= 0x80 else b""
        else:
            try:
                data = form.encode(wrong)
            except UnicodeEncodeError:
                data = b""
        if data and data.decode(right, "ignore") != form:  # else nothing was read wrongly
            out.append((data, cost, True))
    return tuple(out)


class Trie:
    """Words as byte strings; nodes are dictionaries, a word's end holds the indexes of all words spelt so."""

    def __init__(self):
        self.root: dict = {}

    def add(self, data: bytes, index: int, cost: float) -> None:
        node = self.root
        for b in data:
            node = node.setdefault(b, {})
        node.setdefault(-1, []).append((index, cost))


class Model:
    """Word frequencies of the corpus and the tries of its words in every right encoding."""

    def __init__(self, counts: list[tuple[str, int]], total: int, places: dict[str, int] | None = None):
        """places: in how many places of distinct values each word stands; its count where it isn't given."""
        self.places = dict(counts) if places is None else places
        self.words = [w for w, _ in counts]
        self.count = dict(counts)
        self.cost = [math.log(max(total, 1) / n) for _, n in counts]
        self.known: dict[str, tuple[float, str] | None] = {}
        self.finals: dict[str, str] = {}  # what words that are garbled themselves were
        self.tries: dict[str, Trie] = {}
        for name in RIGHT:
            trie = Trie()
            for i, w in enumerate(self.words):
                if w.isascii() or "�" in w:
                    continue
                for form, extra in {w: 0.0, w.lower(): CASE, w.upper(): CASE}.items():
                    try:
                        trie.add(form.encode(name), i, self.cost[i] + extra)
                    except UnicodeEncodeError:
                        continue
                    if name == "utf-8" and extra == 0.0:
                        trie.add(b"\xef\xbb\xbf" + form.encode(name), i, self.cost[i] + 1.0)
            self.tries[name] = trie
        # byte order marks stand before words without other wide characters, too
        for i, w in enumerate(self.words):
            if w.isascii():
                self.tries["utf-8"].add(b"\xef\xbb\xbf" + w.encode(), i, self.cost[i] + 1.0)

    def search(self, word: str, wrong: str, right: str, fits: Callable[[int], bool]) -> tuple[float, int] | None:
        """Viterbi over (position, trie node, lost bytes): the least cost and the index of a model word that it spells and
        that fits, if any."""
        trie = self.tries[right].root
        # state: (node identity, garbled arcs, lost bytes) -> (cost, node); one dictionary per position
        states: dict[tuple[int, bool, int], tuple[float, dict]] = {(id(trie), False, 0): (0.0, trie)}
        for char in word:
            arcs = char_arcs(char, wrong, right)
            if not arcs:
                return None
            nexts: dict[tuple[int, bool, int], tuple[float, dict]] = {}

            def put(node: dict, cost: float, lost: int, garbled: bool, nexts=nexts) -> None:
                key = (id(node), garbled, lost)
                if key not in nexts or nexts[key][0] > cost:
                    nexts[key] = (cost, node)

            for (_, garbled, lost), (cost, node) in states.items():
                for at, paid, gone in self._losses(node, cost, lost) if garbled else ((node, cost, lost),):
                    for data, price, bad in arcs:
                        if data is None:
                            self._any(at, paid + price, gone, put)
                            continue
                        step = at
                        for b in data:
                            step = step.get(b)
                            if step is None:
                                break
                        if step is not None:
                            put(step, paid + price, gone, garbled or bad)
            if not nexts:
                return None
            states = nexts  # a few for each node of the trie: nothing else bounds the search
        best = None
        for (_, garbled, lost), (cost, node) in states.items():
            if garbled:
                for at, paid, _ in self._losses(node, cost, lost):
                    for index, price in at.get(-1, ()):
                        if (best is None or (paid + price, index) < best) and fits(index):
                            best = (paid + price, index)
        return best

    @staticmethod
    def _losses(node: dict, cost: float, lost: int) -> list[tuple[dict, float, int]]:
        """(node, cost, lost bytes): node itself and those that bytes lost here lead to."""
        out = level = [(node, cost, lost)]
        for _ in range(lost, MOST_LOST):
            level = [(child, paid + LOST, gone + 1) for at, paid, gone in level for b, child in at.items() if b >= 0x80]
            if not level:
                break
            out = out + level
        return out

    @staticmethod
    def _any(node: dict, cost: float, lost: int, put) -> None:
        """One character lost or replaced: a character's bytes from 0x80 on, any of them but a byte order mark."""
        level = [(b"", node)]
        for _ in range(LONGEST):
            level = [(path + bytes((b,)), child) for path, at in level for b, child in at.items() if b >= 0x80]
            for path, child in level:
                if path != b"\xef\xbb\xbf":
                    put(child, cost, lost, True)

    def likelier(self, text: str, word: str) -> bool:
        """Whether text stands ODDS times as often as word: over distinct values, so that copies of a garbled value don't
        count, or over all where distinct values say nothing else."""
        n, places = self.count.get(word, 0), self.places.get(word, 0)
        return bool(likelier(self.count.get(text, 0), self.places.get(text, 0), n, places, len(word) >= LEAST_LENGTH))

    def decode(self, word: str) -> str | None:
        """The word that `word` is surely a garbled form of, or None if it isn't one."""
        found, sure, _ = self.judge(word)
        return found if sure else None

    def judge(self, word: str) -> tuple[str | None, bool, float | None]:
        """(restored, sure, cost). Restored and not sure: valid UTF-8 that only counts beside surely garbled words. The cost
        is that of a path, None without one: words that the model doesn't hold may have a cheaper one."""
        text, sure = word, False
        while (plain := as_utf8(text)) is not None and (plain[1] or sure) and plain[0] != text:
            text, sure = plain[0], True
        if sure:
            return (self._known(text) or text), True, None
        found = self._known(word)
        if found is not None:
            return found, True, self.cheapest(word)[0]
        plain = as_utf8(word)
        return (plain[0], False, None) if plain else (None, False, None)

    def _known(self, word: str) -> str | None:
        seen = {word}
        found = None
        while (hit := self.cheapest(found or word)) is not None and hit[1] not in seen:
            found = hit[1]  # what was garbled twice may first lead to what was garbled once
            seen.add(found)
        return found

    def cheapest(self, word: str) -> tuple[float, str] | None:
        """(cost, text) of the cheapest path to a text that is likelier than word."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= KEPT:
            self.known.clear()
        best: tuple[float, str] | None = None
        if any(c.isalnum() or not c.isascii() for c in word):
            better: dict[str, bool] = {}
            for rank, text in enumerate(_undone(word)):
                if rank and self.likelier(text, word) and self.finals.get(text, text).lower() != word.lower():
                    found = (CHANNEL * rank, text)
                    best = min(best, found) if best else found

                def fits(index: int, text=text) -> bool:
                    w = self.words[index]
                    if w not in better:
                        better[w] = self.likelier(w, word)
                    return better[w] and w.lower() not in (word.lower(), text.lower()) and self.finals.get(w, w).lower() != word.lower()

                for i, wrong, j, right in channels(text):
                    if hit := self.search(text, wrong, right, fits):
                        found = (hit[0] + CHANNEL * (rank + 1) + 0.1 * (i + j), self.words[hit[1]])
                        best = min(best, found) if best else found
        self.known[word] = best
        return best


@functools.lru_cache(4096)
def channels(text: str) -> list[tuple[int, str, int, str]]:
    """(i, wrong, j, right): pairs of encodings in which text may be garbled, each with its rank."""
    out: list[tuple[int, str, int, str]] = []
    if text.isascii() and "?" not in text:
        return out
    special = tuple(dict.fromkeys(c for c in text if c == "?" or not c.isascii()))
    for j, right in enumerate(RIGHT):
        seen = set()  # a later encoding that reads these characters alike finds the same at a higher cost
        for i, wrong in enumerate(WRONG):
            lattice = tuple(char_arcs(c, wrong, right) for c in special)
            # every character needs an arc, and without a garbled one there is nothing to find
            if right == wrong or lattice in seen or not all(lattice) or not any(bad for arcs in lattice for _, _, bad in arcs):
                continue
            seen.add(lattice)
            out.append((i, wrong, j, right))
    return out


def likelier(n, places, word_n, word_places, long):
    """Of counts or columns of counts: ODDS times as often over all rows, where the distinct values don't say the opposite,
    or, of a long word, over distinct values."""
    return (long & (n > 0) & (places >= ODDS * word_places)) | ((n > 0) & (places >= word_places) & (n >= ODDS * word_n))


def _undone(word: str) -> Iterator[str]:
    """word, and what it was before entities, UTF-7 or further rounds of wrong reading; each such form is shorter."""
    seen = {word}
    yield word
    queue = [word]
    while queue:
        text = queue.pop(0)
        forms = []
        if _ENTITY.search(text):
            forms.append(html.unescape(text))
        if _UTF7.search(text):
            try:
                forms.append(_UTF7.sub(lambda m: m[0].encode().decode("utf-7"), text))
            except UnicodeDecodeError:
                pass
        if not text.isascii():
            forms += [once(text, wrong) for wrong in ("cp1252", "latin-1")]
        for f in forms:
            f = shape(f)
            if f not in seen and f:
                seen.add(f)
                queue.append(f)
                yield f


_SLOPPY: dict[str, dict[str, int]] = {}


def once(text: str, wrong: str) -> str:
    """One round undone where it can be: runs of UTF-8 that were read in a single-byte encoding; the rest stays."""
    if wrong not in _SLOPPY:
        _SLOPPY[wrong] = _byte_table(wrong)
    table = _SLOPPY[wrong]
    data = [table.get(c, 0) for c in text]
    out, at = [], 0
    while at < len(text):
        size = 1
        if data[at] >= 0xC2:
            size = 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        raw = bytes(data[at : at + size])
        try:
            if size == 1 or len(raw) < size or min(raw) < 0x80:
                raise ValueError
            out.append(raw.decode("utf-8"))
        except ValueError:
            size = 1
            out.append(text[at])
        at += size
    return "".join(out)


# -- the distributed steps -------------------------------------------------------------------------------------------


def _decode(shared, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or Model(*shared.value)
            judged = [(w, *model.judge(w)) for w in pdf["word"].array]
            # beside a path, what is only coded may cost less
            forms = [[(f, None) for f in candidates(w)] if not sure else [(f, CHANNEL * i) for i, f in enumerate(_undone(w)) if i and CHANNEL * i < cost] if cost is not None else None for w, _, sure, cost in judged]
            # open: no path, or perhaps a cheaper one to a rarer word
            more = [not sure or (cost is not None and cost > least) for _, _, sure, cost in judged]
            forms = [None if x is None else [{"form": f, "price": price} for f, price in x] for x in forms]
            yield pdf.assign(restored=[x[1] for x in judged], sure=[x[2] for x in judged], cost=pd.array([x[3] for x in judged], "Float64"), forms=forms, open=more)

    return run


def _ascii(data: bytes) -> str:
    return "".join(chr(b) for b in data if b < 0x80 and b != 0x3F)


def _fixed(key: str) -> str:
    """What of a key is no trailing byte of any encoding: signs before the digits, and those between digits and letters."""
    return "~" + "".join(c for c in key if c < "0" or "9" < c < "@")


def target_keys(word: str) -> set[str]:
    """The ASCII bytes, but question marks, of the forms of word that are in a trie, and what of them is fixed. On a path, they
    are those of the garbled word: only other bytes are lost, replaced or put in their place."""
    if "\ufffd" in word:
        return set()
    keys = set()
    for form in (word,) if word.isascii() else (word, word.lower(), word.upper()):
        for right in ("utf-8",) if word.isascii() else RIGHT:
            try:
                keys.add(_ascii(form.encode(right)))
            except UnicodeEncodeError:
                continue
    return {"=" + k for k in keys} | {_fixed(k) for k in keys}


def seeker_keys(word: str) -> set[str]:
    """The keys of all words that a path of word may end in."""
    keys = set()
    for text in _undone(word) if any(c.isalnum() or not c.isascii() for c in word) else ():
        seen = set()
        for _, wrong, _, right in channels(text):
            parts = tuple(frozenset(_ascii(data) for data, _, _ in char_arcs(c, wrong, right) if data is not None) or frozenset(("",)) for c in text if c != "?")
            if parts in seen:
                continue
            seen.add(parts)
            if math.prod(map(len, parts)) <= MOST_KEYS:
                keys.update("=" + "".join(k) for k in itertools.product(*parts))
            else:  # wide characters whose trailing bytes are letters: these aside, all forms are the same
                keys.update(_fixed("".join(k)) for k in itertools.product(*[{_fixed(x)[1:] for x in p} for p in parts]))
    return keys


def _keyed(keys: Callable[[str], set[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[sorted(keys(w)) for w in pdf["word"].array]).explode("key").dropna(subset="key")

    return run


def _searched(total: int):
    def run(seekers: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        model = Model(list(zip(targets["word"], targets["n"], strict=True)), total, dict(zip(targets["word"], targets["places"], strict=True)))
        model.finals = dict(zip(targets["word"], targets["final"], strict=True))
        out = []
        for word, n, places in zip(seekers["word"], seekers["n"], seekers["places"], strict=True):
            model.count.setdefault(word, n)
            model.places.setdefault(word, places)
            if hit := model.cheapest(word):
                out.append((word, hit[0], model.finals.get(hit[1], hit[1])))
        return pd.DataFrame(out, columns=["word", "cost", "restored"])

    return run


def search_rare(seekers: DataFrame, targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """(word, cost, restored) of the words of seekers(word, n, places) that words of targets(word, n, places, final) explain,
    however many these are: the same search as for the model's words, among the targets whose ASCII bytes agree, in blocks
    of them. final is the target, or what it was if it is garbled itself."""
    tasks = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # named, as few bytes take long here
    columns = "word string, n long, places long, {}key string"
    of = cut_lineage(targets.select("word", "n", "places", "final").mapInPandas(_keyed(target_keys), columns.format("final string, ")))
    by = cut_lineage(seekers.select("word", "n", "places").repartition(tasks, "word").mapInPandas(_keyed(seeker_keys), columns.format("")))
    sizes = by.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts")).join(of.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")), "key")
    sizes = cut_lineage(sizes)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def one(n: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(n))

    # every part of a key's seekers meets every block of its targets
    left = by.join(sizes, "key").select(*by.columns, one("parts").alias("part"), every("blocks").alias("block"))
    right = of.join(sizes, "key").select(*of.columns, every("parts").alias("part"), one("blocks").alias("block"))
    on = ("key", "part", "block")
    found = left.repartition(tasks, *on).groupBy(*on).cogroup(right.repartition(tasks, *on).groupBy(*on)).applyInPandas(_searched(total), "word string, cost double, restored string")
    best = found.groupBy("word").agg(F.min(F.struct("cost", "restored")).alias("best"))
    return best.select("word", "best.*")


def _followed(decoded: DataFrame) -> DataFrame:
    """decoded with what was restored to a garbled word restored further, as far as it goes."""
    further = (F.col("further") != F.col("restored")) & (F.lower("further") != F.lower("word"))
    for _ in range(32):  # steps double, so chains of any length end before; words that lead to one another have no end
        to = decoded.filter("sure").select(F.col("word").alias("restored"), F.col("restored").alias("further"))
        step = cut_lineage(decoded.join(to, "restored", "left").select(*decoded.columns, F.when(further, F.col("further")).alias("further")))
        if step.filter("further IS NOT NULL").isEmpty():
            break
        decoded = step.withColumn("restored", F.coalesce("further", "restored")).select(*decoded.columns)
    return decoded


def _restore(value: str, changes: list) -> str:
    """value with its words at the given places replaced; numbers stay those of the value."""
    parts = re.split("([ \t\r\n\f\v]+)", value)
    places = [i for i in range(0, len(parts), 2)]
    for change in changes:
        at = places[change["pos"]]
        numbers = iter(_NUMBER.findall(parts[at]))
        new = change["restored"]
        if new.count("9") == len(_NUMBER.findall(parts[at])):
            new = re.sub("9", lambda m: next(numbers), new)
        parts[at] = new
    return "".join(parts)


def garbled(values: DataFrame, share: float = MODEL_SHARE) -> DataFrame:
    """(value, copies, restored) of the distinct garbled values of values(value); restored has garbled words replaced
    by the words they were, and is NULL where nothing could be restored.

    NULL, empty and blank values are never garbled. Word frequencies cover all values, so a value that repeats counts as
    often as it stands there; words are compared over distinct values first. Words that make up less than share of all are
    searched in blocks instead of the model. An empty table, or one whose words are all rare, gives only values with broken characters.
    """
    spark = values.sparkSession
    distinct = cut_lineage(values.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("copies")))
    split = F.split("value", "[ \\t\\r\\n\\f\\x0B]+")
    long = distinct.select("value", "copies", F.posexplode(split).alias("pos", "raw")).filter("raw <> ''").withColumn("word", F.when(F.col("raw").rlike(CODED), F.col("raw")).otherwise(F.regexp_replace("raw", "[0-9]+", "9")))
    words = cut_lineage(long.groupBy("word").agg(F.sum("copies").alias("n"), F.count("*").alias("places")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_model = (F.col("n") >= F.lit(share) * total) & (F.col("n") > 1)
    known = words.filter(in_model).select("word", "n", "places").collect()
    shared = spark.sparkContext.broadcast((sorted((r["word"], r["n"]) for r in known), total, {r["word"]: r["places"] for r in known}))
    # words that the model doesn't hold, of those that can be likelier than any other
    others = words.filter(~in_model & (F.col("n") >= ODDS))
    most = others.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    least = CHANNEL + math.log(total / most) if most else math.inf
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doubtful = words.filter(F.col("word").rlike(DOUBTFUL)).repartition(parts, "word")
    judged = cut_lineage(doubtful.mapInPandas(_decode(shared, least), "word string, n long, places long, restored string, sure boolean, cost double, forms array<struct<form:string,price:double>>, open boolean"))
    # every lossless form of what is still open, or of what is coded, against the counts of all words
    forms = judged.select("word", F.col("n").alias("word_n"), F.col("places").alias("word_places"), F.inline("forms"))
    met = forms.join(words.select(F.col("word").alias("form"), "n", "places"), "form")
    met = met.filter(likelier(F.col("n"), F.col("places"), F.col("word_n"), F.col("word_places"), F.length("word") >= LEAST_LENGTH))
    rare = met.groupBy("word").agg(F.max_by(F.struct("form", "price"), F.struct(-F.coalesce("price", F.lit(0.0)), "n", "form")).alias("rare")).select("word", "rare.*")
    decoded = judged.drop("forms").join(rare, "word", "left").withColumn("open", F.col("open") & (F.col("form").isNull() | F.coalesce(F.col("price") > least, F.lit(False))))
    decoded = decoded.withColumn("restored", F.coalesce("form", "restored")).withColumn("sure", F.col("sure") | F.col("form").isNotNull()).withColumn("cost", F.coalesce("price", "cost")).drop("form", "price")
    decoded = cut_lineage(decoded)
    if most:  # and every path of it to the words that the model doesn't hold
        finals = decoded.filter("sure").select("word", F.col("restored").alias("final"))
        targets = others.join(finals, "word", "left").withColumn("final", F.coalesce("final", "word"))
        found = search_rare(decoded.filter(F.col("open") & (F.col("places") * ODDS <= most)), targets, total)
        decoded = decoded.join(found.select("word", F.col("cost").alias("rare_cost"), F.col("restored").alias("rare")), "word", "left")
        cheaper = F.col("rare").isNotNull() & (F.col("cost").isNull() | (F.col("rare_cost") < F.col("cost")))
        decoded = decoded.withColumn("restored", F.when(cheaper, F.col("rare")).otherwise(F.col("restored"))).withColumn("sure", F.col("sure") | F.col("rare").isNotNull())
    decoded = _followed(cut_lineage(decoded.filter("restored IS NOT NULL").select("word", "places", "restored", "sure")))
    places = words.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    hits = join_by_share(long.select("value", "pos", "word").filter(F.col("value").rlike(DOUBTFUL)), decoded, "word", "places", places)
    changes = hits.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("pos", "restored"))).alias("changes"), F.bool_or("sure").alias("sure")).filter("sure").drop("sure")

    @F.pandas_udf("string")
    def restore(value: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([_restore(v, c) if c is not None and len(c) else None for v, c in zip(value.array, changes.array, strict=True)], dtype=object)

    broken = distinct.filter(F.col("value").rlike(BROKEN)).select("value", F.lit(None).cast(changes.schema["changes"].dataType).alias("changes"))
    both = changes.unionByName(broken).groupBy("value").agg(F.max_by("changes", F.size("changes")).alias("changes"))
    return both.join(distinct, "value").select("value", "copies", restore("value", "changes").alias("restored"))
