import base64
import random

import public_tokenizers
import pytest
import tiktoken
from edge_cases import edge_docs, no_docs  # noqa: F401

from panelcast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", "b", " ", "aa", "the", "  ", "\n", "1", "é", "漢", "😀", "'s", "!", "\x00", "\t", "\x1c", "\x85"]


def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read(), public_tokenizers.PATTERN)


def unpacked(ids):
    return list(memoryview(ids).cast("I"))


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def expected(own):
    return library(own.ranks).encode_ordinary


@pytest.mark.parametrize("segment", [1_000_000, 7])
def test_as_the_library(own, expected, segment, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    texts = random_texts(1500, segment) + ["", "a" * 3000, "ab" * 2000, "=-" * 2000]
    for text, ids in zip(texts, own.encode(texts)):
        assert unpacked(ids) == expected(text)
        assert own.decode(ids) == text.encode()


def test_little_memory_gives_the_same(own, monkeypatch):
    texts = random_texts(300, 3)
    expected = own.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 500)
    monkeypatch.setattr(bpe, "ENCODED_AT_ONCE", 100)
    monkeypatch.setattr(bpe, "MERGED_AT_ONCE", 10)
    with open(PATH, "rb") as file:
        assert bpe.Codec(file.read(), public_tokenizers.PATTERN).encode(texts) == expected


def test_memory_is_bounded_in_bytes(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 100_000)
    rng = random.Random(8)
    for _ in range(30):
        own.encode(["".join(rng.choice("abcdef") for _ in range(20_000))])
        assert sum(map(len, own.known)) + sum(map(len, own.spaced)) <= 100_000


def test_ranks_out_of_order():
    """Vocabularies in which a join makes a pair of a smaller rank."""
    rng = random.Random(9)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 290:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        longer = [t for t in tokens if len(t) > 1]
        rng.shuffle(longer)
        order = [bytes([b]) for b in range(256)] + longer
        ranks = {t: i for i, t in enumerate(order)}
        lines = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
        codec = bpe.Codec(lines, public_tokenizers.PATTERN)
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(50)]
        expected = library(ranks).encode_ordinary
        for text, ids in zip(texts, codec.encode(texts)):
            assert unpacked(ids) == expected(text)


def test_edges(spark, edge_docs, no_docs, expected):
    columns = bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    rows = (
        edge_docs.select("text", columns.encode("text").alias("ids"))
        .withColumn("decoded", columns.decode("ids"))
        .collect()
    )
    assert len(rows) == edge_docs.count()
    for row in rows:
        text = row["text"] or ""
        assert unpacked(bytes(row["ids"])) == expected(text)
        assert bytes(row["decoded"]) == text.encode()
    assert no_docs.select(columns.encode_and_decode("text")).count() == 0
