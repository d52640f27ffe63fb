import math
import random
import re

import pytest
from edge_cases import edge_docs, no_docs  # noqa: F401

from panelcast.llm import lexical
from panelcast.llm.lexical import search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, plain_terms(t)) for d, t in docs]
    counted = [(d, t) for d, t in counted if t]
    n_docs, n_terms = len(counted), sum(len(t) for _, t in counted)
    out = []
    for item, text in items:
        terms, scores = set(plain_terms(text)), []
        weights = {
            t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in counted) + 1)))
            for t in terms
        }
        for doc, own in counted:
            m = 100 - 90 + (90 * len(own) * n_docs) // n_terms
            score = sum(
                w * ((10**9 * own.count(t)) // (1000 * own.count(t) + 8 * m))
                for t, w in weights.items()
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: s[:2] + ((s[2],) if s[2] is not None else ()))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(scores[:k], 1)]
    return out


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_terms():
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0, 0x180)] + ["Ж", "漢", " "]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(40))
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("width", [1, 16, 2048])
def test_as_brute_force(spark, scratch, monkeypatch, width):
    """Whatever the sketches' width: they bound, they do not decide."""
    monkeypatch.setattr(lexical, "WIDTH", width)
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 7)
    rng = random.Random(width)
    words = [f"w{i}" for i in range(60)]
    docs = [
        (d, " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 50))))
        for d in range(120)
    ]
    docs += [(200 + i, docs[3][1]) for i in range(15)]  # Ties.
    items = [(i, " ".join(rng.sample(words, 5))) for i in range(12)] + [(99, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert found(search(frame, queries, scratch, k=4)) == sorted(brute(docs, items, 4), key=repr)


def test_blocks_of_queries(spark, scratch, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 10)
    docs = [("a", "red green"), ("b", "green blue blue"), (None, "red red"), ("d", None)]
    items = [(1, "red"), (1, "green blue"), (None, "blue"), (4, ""), (5, None), (6, "red")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    queries = spark.createDataFrame(items, "item_id int, text string")
    result = search(frame, queries, scratch)
    assert found(result) == sorted(brute(docs, items, 10), key=repr)
    assert result.schema["doc_id"].dataType.simpleString() == "string"


def test_edges(spark, scratch, edge_docs, no_docs):
    queries = edge_docs.selectExpr("doc_id AS item_id", "text", "uid AS query", "fp AS score")
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert found(search(edge_docs, queries, scratch)) == sorted(brute(docs, docs, 10), key=repr)
    assert search(no_docs, queries, scratch).count() == 0
    assert search(edge_docs, queries.limit(0), scratch).count() == 0
