import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quantaloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_every_code_point(own, other):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 512):
        text = "".join(f"a{c} {c}{c}1" for c in chars[i : i + 512])
        assert own.encode(text) == other.encode_ordinary(text)


def test_random_words(own, other):
    rng = random.Random(1)
    syllables = ["th", "er", "ci", "ón", "ß", "eux", "ing", "  ", "\n", "7", "!!", "'s", "a", "aa", "\t", "é", "中", "…"]
    for _ in range(3000):
        text = "".join(rng.choices(syllables, k=rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 9_999, "ab" * 20_000, "é" * 5_000, "-=" * 3_000])
def test_long_pieces(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)


def test_rows(spark, other):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (None, "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as ids", "1 as n_tokens")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = other.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).collect() == []
