import base64
import os
import random

import pytest

from ozalid.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_public_encoder(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabcde éß漢字\n\t '’s12 ЖÃ😀<|endoftext|>re") for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    texts += ["a" * 30000, "ab" * 9000, "漢" * 5000, "<|endoftext|>", " \n \n  x", "   ", "it's we'll 'S", "\x00\x01", "e\u0301"]
    e = T.Encoder()
    assert e.encode(texts) == [reference.encode_ordinary(t) for t in texts]
    assert 0 < e.merged < len(e.words)


def test_small_caches(reference, monkeypatch):
    monkeypatch.setattr(T, "MOST_WORDS", 5)
    monkeypatch.setattr(T, "MOST_PAIRS", 5)
    e = T.Encoder()
    for t in ("the quick brown fox jumps", "unbelievably discombobulated", "the quick brown fox jumps") * 2:
        assert e.encode([t]) == [reference.encode_ordinary(t)]


def test_table(spark, reference):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", None), (4, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["n"]) for r in T.encode_texts(df, "text", ["doc_id"]).selectExpr("doc_id", "size(ids) AS n").collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0), (4, len(reference.encode_ordinary("word " * 50000)))]
    assert sorted(r["n_tokens"] for r in T.count_tokens(df, "text", ["doc_id", "ids"]).collect()) == sorted(n for _, n in got)
    assert T.encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0
    assert T.encode_texts(df.limit(1), "text", ["doc_id"]).first()["ids"] == reference.encode_ordinary("Hello world")
