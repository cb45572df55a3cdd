"""Encoding of whole texts with a public byte-level BPE vocabulary: speculate and verify.

Greedy longest match proposes the tokens of a word; a proposal is the true encoding exactly when every token encodes to
itself and every two neighbours, joined, encode to themselves. These pair checks run for all new words of a batch at
once against a table of known pairs; only words that fail are merged by rank. Workers keep the ids of words they have
met, so the cost of a corpus is that of splitting it into words.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary of the queries here; any ranks file of this format can be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary splits text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs that a worker keeps before it starts anew; some 150 bytes each.
MOST_WORDS = 400_000
MOST_PAIRS = 2_000_000


#: Most bytes of a ranks file, which is broadcast.
MOST_BYTES = 1 << 26


def read_ranks(path: str) -> bytes:
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-level BPE over a ranks file (base64 bytes, rank per line)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, data: bytes | None = None):
        """data: the contents of the file, if they are at hand."""
        lines = (read_ranks(path) if data is None else data).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.starts = {b[:k] for b in self.ranks for k in range(1, len(b) + 1)}
        self.split = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.known = np.empty(0, np.int64)  # pair codes, sorted
        self.fits = np.empty(0, bool)
        self.merged = 0  # words that needed exact merging, for tests

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of least rank first, leftmost of equals; a heap keeps long words at n log n."""
        n = len(word)
        if n == 1:
            return [self.ranks[word]]
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != upto:
                continue  # one of the two has been merged since
            end[i], alive[j] = upto, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (b := before[i]) >= 0 and (r := self.ranks.get(word[b:upto])) is not None:
                heapq.heappush(heap, (r, b, upto))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every single byte is a token, so it always ends."""
        out, at, n = [], 0, len(word)
        while at < n:
            upto, best = at + 1, at + 1
            while upto < n and word[at : upto + 1] in self.starts:
                upto += 1
                if word[at:upto] in self.ranks:
                    best = upto
            out.append(self.ranks[word[at:best]])
            at = best
        return out

    def _check(self, codes: np.ndarray) -> np.ndarray:
        """Which pair codes (left << 32 | right) encode to themselves."""
        new = np.setdiff1d(codes, self.known)
        if len(new):
            fits = np.fromiter((self.merge(self.bytes_of[c >> 32] + self.bytes_of[c & 0xFFFFFFFF]) == [c >> 32, c & 0xFFFFFFFF] for c in new.tolist()), bool, len(new))
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.fits = known[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.known, codes)]

    def learn(self, words: list[str]) -> None:
        """Encodes new words, all at once."""
        if len(self.known) > MOST_PAIRS:
            self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(proposed)), counts)
        inside = owner[1:] == owner[:-1]
        bad = np.zeros(len(proposed), bool)
        if inside.any():
            codes = (flat[:-1][inside] << 32) | flat[1:][inside]
            unique, back = np.unique(codes, return_inverse=True)
            bad[owner[1:][inside][~self._check(unique)[back]]] = True
        for k in np.flatnonzero(bad).tolist():
            proposed[k] = self.merge(raw[k])
        self.merged += int(bad.sum())
        self.words.update(zip(words, proposed, strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """ids of each text; [] for an empty or null one."""
        if len(self.words) > MOST_WORDS:
            self.words = {}
        parts = [self.split(t) if t else [] for t in texts]
        fresh = {w for p in parts for w in p if w not in self.words} if parts else set()
        if fresh:
            self.learn(sorted(fresh))
        words = self.words
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += words[w]
            out.append(ids)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, data: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern, data)
    return _ENCODERS[path, pattern]


def _in_steps(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` characters, so that a batch of very long texts isn't split into words at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_texts(df: DataFrame, text: str, keep: list[str], out: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` and `out`, the token ids of df[text] without special tokens.

    Empty and NULL texts give an empty list. Strings of special tokens are ordinary text. Every row of df gives one row;
    repeated rows repeat. path: the ranks file, which the driver reads and broadcasts. A narrow step.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern, ranks.value)
        for batch in batches:
            at = 0
            for texts in _in_steps(batch.column(batch.num_columns - 1).to_pylist()):
                ids = e.encode(texts)
                ends = np.cumsum([0, *map(len, ids)])
                values = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), lists], [*keep, out])
                at += len(texts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, `{out}` array<int>")


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` and `out`, the number of tokens of df[text]: 0 for empty and NULL texts."""
    source = df.select(*keep, F.col(text).alias("_text"))
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern, ranks.value)
        for batch in batches:
            sizes = [len(x) for texts in _in_steps(batch.column(batch.num_columns - 1).to_pylist()) for x in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*keep, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, `{out}` long")
