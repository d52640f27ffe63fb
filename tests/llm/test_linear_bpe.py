import json
import random

import numpy as np
import public_tokenizers
import pytest
from edge_cases import edge_docs, no_docs  # noqa: F401
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from panelcast.llm import linear_bpe
from panelcast.llm.linear_bpe import LinearBpe, LinearCodec, byte_letters, joined_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "aa", "the", "  ", "\n", "1", "é", "漢", "😀", "'s", "!", "\x00", "\t", "\x1c"]
ODD += ["\x85", " ", "<|endoftext|>", "<|end", "ab", "Ж"]


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return LinearCodec(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), dtype=np.int32)


def agree(codec, library, texts):
    for text in texts:
        ids = ids_of(codec, text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_as_the_library(own, library):
    agree(own, library, random_texts(2000, 5))


def test_long_runs(own, library):
    rng = random.Random(6)
    agree(own, library, ["a" * 5000, "ab" * 3000, "=-" * 2000, " " * 3000, "日本語" * 2000])
    agree(own, library, ["".join(rng.choice(k) for _ in range(30_000)) for k in ("abt", "eh=", "01")])


def test_little_memory_gives_the_same(own, library, monkeypatch):
    monkeypatch.setattr(linear_bpe, "REMEMBERED_BYTES", 1000)
    monkeypatch.setattr(linear_bpe, "REMEMBERED_PAIRS", 3)
    monkeypatch.setattr(linear_bpe, "DECODED_AT_ONCE", 5)
    agree(own, library, random_texts(300, 7))


def small_file(seed):
    """A random vocabulary over few letters, whose merges often compete for the same letters."""
    rng = random.Random(seed)
    letters = {b: c for c, b in byte_letters().items()}
    vocabulary = {letters[b]: b for b in range(256)}
    pool, merges = ["a", "b", "c"], []
    while len(merges) < 40:
        left, right = rng.choice(pool), rng.choice(pool)
        if left + right not in vocabulary:
            vocabulary[left + right] = len(vocabulary)
            merges.append([left, right])
            pool.append(left + right)
    model = models.BPE(vocab=vocabulary, merges=[tuple(m) for m in merges])
    library = Tokenizer(model)
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.decoder = decoders.ByteLevel()
    return library


@pytest.mark.parametrize("seed", range(25))
def test_competing_merges(seed):
    """Also vocabularies with tokens that their own letters are never merged to."""
    library = small_file(seed)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aaabc") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    agree(LinearCodec(library.to_str()), library, texts)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        LinearCodec(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    file = json.loads(open(PATH, "rb").read())
    file["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        LinearCodec(json.dumps(file))


def test_ids_that_are_none(own):
    ids = np.array([0, -1, 50_257, 10**9, 1], dtype=np.int32)
    assert own.decode(ids) == own.decode(ids[[0, 4]])


def test_edges(spark, edge_docs, no_docs, library):
    columns = LinearBpe(spark, PATH)
    rows = (
        edge_docs.select("text", columns.encode("text").alias("ids"))
        .withColumn("decoded", columns.decode("ids"))
        .withColumn("joined", joined_ids("ids"))
        .collect()
    )
    assert len(rows) == edge_docs.count()
    for row in rows:
        expected = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == expected and row["decoded"] == (row["text"] or "")
        assert row["joined"] == ",".join(map(str, expected))
    assert no_docs.select(columns.encode_and_decode("text")).count() == 0
    odd = spark.createDataFrame([(1, [1, None, 2]), (2, None), (3, [])], "k int, ids array<int>")
    found = {r["k"]: r["d"] for r in odd.select("k", columns.decode("ids").alias("d")).collect()}
    assert found[2] is None and found[3] == "" and len(found[1]) > 0
