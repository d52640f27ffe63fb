"""The registered queries against SQL, and the stages against plain Python."""

import glob
import os

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from panelcast.llm import oracle, queries
from panelcast.llm.bpe import Codec

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.registered(), oracle.statements()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    assert found == sorted(repr(tuple(r)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_per_input(spark, name):
    table = "pages" if name.startswith(("op1_", "op5_")) else "documents"
    rows = QUERIES[name](spark, SMALL).count()
    assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_stages(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, SMALL), name.replace(" ", "_"))
        at[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.filter("n_chars != length(text)").count() == 0
        assert set(ids(docs)) <= set(ids(before))
    kept, single, private, mixed, encoded = at.values()
    assert len(ids(single)) == len(set(ids(single))) < len(ids(kept))
    assert sorted(ids(private)) == sorted(ids(single))
    assert private.filter("text RLIKE '@[a-z0-9]+[.]example[.]com'").count() == 0
    assert sorted(ids(encoded)) == sorted(ids(mixed))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        own = Codec(file.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}
    )
    for row in encoded.collect():
        packed = list(memoryview(bytes(row["ids"])).cast("I"))
        assert packed == library.encode_ordinary(row["text"]) and row["n_tokens"] == len(packed)


def ids(frame):
    return [r["doc_id"] for r in frame.select("doc_id").collect()]
