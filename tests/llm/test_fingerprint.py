import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from edge_cases import edge_docs  # noqa: F401

from panelcast.llm import fingerprint as fp


def brute(docs):
    """Rows by descending id, each with its edited text."""
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(text) // 3
        edited = (text[: len(text) - k] + following[:k]).encode()
        yield (
            doc_id,
            len(text),
            hashlib.sha256(edited).hexdigest(),
            fp.simhash(text.encode()),
            fp.simhash(edited),
            fp.simhash(following.encode()),
        )


@pytest.mark.parametrize("rows_at_once", [1, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_edited(spark, scratch, n, rows_at_once, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_AT_ONCE", rows_at_once)
    rng = random.Random(n)
    texts = [None, "", "é", "ab", "one two three 😀 four", "x y " * 5000]
    docs = [(i * 3, rng.choice(texts) if i % 2 else f"text {i} of many") for i in range(n)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1))
    found = sorted(map(tuple, fp.edited_with_next(frame.repartition(7), scratch).collect()))
    assert found == sorted(brute([(i, t or "") for i, t in docs]))


def test_edges(edge_docs, scratch):
    rows = fp.edited_with_next(edge_docs, scratch).collect()
    assert len(rows) == edge_docs.count()
    # Equal texts have equal fingerprints, whatever follows.
    assert len({r["fp"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert {r["fp"] for r in rows if r["n_chars"] == 0} == {0}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        values += [v, v]
        for _ in range(12):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    rows = [(i, signed(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    counted = fp.count_near(frame, F.col("doc_id") % 3 == 0, radius).collect()
    array = np.array(values, dtype=np.uint64)
    assert len(counted) == len(rows)
    for row in counted:
        near = int((np.bitwise_count(array ^ array[row["doc_id"]]) <= radius).sum())
        assert row["n_near"] == (near if row["doc_id"] % 3 == 0 else None)


def test_likeness(spark):
    rows = spark.createDataFrame([(5, 5), (0, -1), (0, 0xFFFF)], "a long, b long")
    found = [r[0] for r in rows.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([1.0, 0.0, 2**-0.5])


def test_ids_that_are_text(spark, scratch):
    rows = [(k, f"some words of {k}") for k in ("a", "b", "c")] + [(None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r["doc_id"]: r["n_chars"] for r in fp.edited_with_next(docs, scratch).collect()}
    assert found == {k: len(t) for k, t in rows}
