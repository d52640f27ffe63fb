"""Ranked lexical search with upper bounds from hashed max-sketches."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.text import whole
from panelcast.sources.scratch import Scratch

# Coordinates of each of a document's two sketches, and documents sketched together.
WIDTH = 2048
DOCS_AT_ONCE = 256
# Bytes of query texts that are broadcast at once; more are searched in further passes.
BLOCK_BYTES = 16 * 1024 * 1024
# Groups that a query's best documents of all tasks are ranked in before they meet.
SALTS = 1024

# A-Z lowered; every other ASCII character that is no letter or digit ends a term.
_FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return raw.translate(_FOLDED).split()


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // n_terms


def impact(tf, m):
    """What a term adds per unit of its weight; rises with ``tf``. Numbers or arrays."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class QueryBlock:
    """A bounded block of queries: their terms, and once counted, the terms' weights."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        vocabulary: dict[bytes, int] = {}
        self.terms: list[list[int]] = []
        for _, raw in rows:
            distinct = dict.fromkeys(terms_of(raw))
            self.terms.append([vocabulary.setdefault(t, len(vocabulary)) for t in distinct])
        self.vocabulary = list(vocabulary)
        self.weights: list[int] = []
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, holders: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = [
            math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(t, 0) + 1)))
            for t in range(len(self.vocabulary))
        ]


def blocks_of(queries: DataFrame, id_column: str, text_column: str) -> Iterator[QueryBlock]:
    """The queries as blocks of at most ``BLOCK_BYTES`` (or one text), read one by one."""
    rows, size = [], 0
    binary = whole(text_column).cast("binary")
    for query_id, raw in queries.select(F.col(id_column), binary).toLocalIterator():
        if rows and size + len(raw) > BLOCK_BYTES:
            yield QueryBlock(rows)
            rows, size = [], 0
        rows.append((query_id, bytes(raw)))
        size += len(raw)
    if rows:
        yield QueryBlock(rows)


DOCS, TERMS = -1, -2


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes]) -> Iterator:
    """One task's share of the counts: ``(term, n)`` and the two sums over all documents."""
    number = {t: i for i, t in enumerate(vocabulary)}
    wanted = number.keys()
    holders: Counter = Counter()
    for batch in batches:
        for raw in batch.column(0):
            terms = terms_of(raw.as_buffer().to_pybytes())
            if terms:
                holders[DOCS] += 1
                holders[TERMS] += len(terms)
                holders.update(map(number.__getitem__, wanted & set(terms)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in ((holders.keys(), pa.int32()), (holders.values(), pa.int64()))],
        names=["term", "n"],
    )


def weigh(documents: DataFrame, block: QueryBlock, text_column: str) -> None:
    """Count, over all documents, what the weights of a block of queries need.

    Every task adds up its own documents; a number per term of the block reaches the driver.
    """
    shared = documents.sparkSession.sparkContext.broadcast(block.vocabulary)
    counts = (
        documents.select(whole(text_column).cast("binary"))
        .mapInArrow(lambda batches: _counted(batches, shared.value), "term int, n long")
        .groupBy("term")
        .agg(F.sum("n"))
    )
    found = dict(map(tuple, counts.collect()))
    block.weigh(found.pop(DOCS, 0), found.pop(TERMS, 0), found)
    shared.unpersist()


class _Last:
    """Sorts null ids behind all others."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return self.value is not None and (other.value is None or self.value < other.value)

    def __eq__(self, other) -> bool:
        return self.value == other.value


class Searcher:
    """One task's search: sketches of a few documents at a time, and each query's best so far."""

    def __init__(self, block: QueryBlock, k: int):
        self.block, self.k = block, k
        self.best: list[list[tuple]] = [[] for _ in block.ids]
        self.least = np.zeros(len(block.ids), dtype=np.int64)
        # Queries without terms find nothing; the others' terms lie one behind the other.
        self.asked = [q for q, terms in enumerate(block.terms) if terms]
        flat = [t for q in self.asked for t in block.terms[q]]
        self.flat = np.array(flat, dtype=np.int64)
        self.starts = np.cumsum([0, *(len(block.terms[q]) for q in self.asked)])[:-1]
        self.flat_weights = np.array([block.weights[t] for t in flat], dtype=np.int64)[:, None]
        self.first, self.second = self._coordinates(block.vocabulary)

    @staticmethod
    def _coordinates(terms) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.fromiter(map(hash, terms), dtype=np.int64)
        return hashes & (WIDTH - 1), (hashes >> 24) & (WIDTH - 1)

    def add(self, ids: list, texts: list[bytes]) -> None:
        block = self.block
        counts = [Counter(terms_of(t)) for t in texts]
        n_docs = len(texts)
        parts = [length_part(c.total(), block.n_docs, block.n_terms) for c in counts]
        owner = np.repeat(np.arange(n_docs), [len(c) for c in counts])
        terms = [t for c in counts for t in c]
        tf = np.array([n for c in counts for n in c.values()], dtype=np.int64)
        # An impact is the same for a term and for whatever shares its coordinate at most.
        impacts = impact(tf, np.array(parts, dtype=np.int64)[owner])
        bounds = None
        for at, asked in zip(self._coordinates(terms), (self.first, self.second)):
            sketch = np.zeros((WIDTH, n_docs), dtype=np.int64)
            np.maximum.at(sketch.reshape(-1), at * n_docs + owner, impacts)
            found = sketch[asked]
            bounds = found if bounds is None else np.minimum(bounds, found)
        # All queries look their terms up at once: the sum of their bounds, document by document.
        tops = np.add.reduceat(bounds[self.flat] * self.flat_weights, self.starts, axis=0)
        hopeful = (tops > 0) & (tops >= self.least[self.asked][:, None])
        for row in np.flatnonzero(hopeful.any(axis=1)):
            self._rescore(self.asked[row], tops[row], ids, counts, parts)

    def _rescore(self, query: int, tops: np.ndarray, ids: list, counts: list, parts: list) -> None:
        """Exact scores by descending bound, until the bound is below the k-th best score."""
        block, best = self.block, self.best[query]
        terms = [(block.vocabulary[t], block.weights[t]) for t in block.terms[query]]
        for doc in np.argsort(-tops, kind="stable").tolist():
            if tops[doc] <= 0 or tops[doc] < self.least[query]:
                break
            count, m, score = counts[doc], parts[doc], 0
            for term, weight in terms:
                tf = count.get(term)
                if tf is not None:
                    score += weight * impact(tf, m)
            if score > 0:
                insort(best, (-score, _Last(ids[doc])))
                del best[self.k :]
                if len(best) == self.k:
                    self.least[query] = -best[-1][0]


def _searched(batches: Iterator, block: QueryBlock, k: int, schema: pa.Schema) -> Iterator:
    searcher = Searcher(block, k)
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(start, DOCS_AT_ONCE)
            searcher.add(part.column(0).to_pylist(), part.column(1).to_pylist())
    rows = [
        (query, block.ids[query], doc_id.value, -score)
        for query, best in enumerate(searcher.best)
        for score, doc_id in best
    ]
    columns = zip(*rows) if rows else [()] * len(schema)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def search(
    documents: DataFrame,
    queries: DataFrame,
    scratch: Scratch,
    k: int = 10,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each query.

    A score sums the weighted impacts of a query's distinct terms (fixed whole-number formula, see
    ``impact``, ``length_part`` and ``QueryBlock.weigh``); documents without a score above zero are
    no results, equal scores rank by ``doc_id``, nulls last.

    Each task folds the impacts of a document's terms into the maxima of two hashed sketches. A
    term's impact is at most the lesser of its two coordinates, so the weighted sum of these bounds
    the score. All queries of a block look up their terms in a few hundred sketches at once; the
    documents of a query are then scored exactly by descending bound until the bound falls below
    the k-th best score so far. At most ``k`` rows per query leave a task, whatever it reads, so
    no document and no common term makes a group that grows.

    Queries are read in blocks of bounded size, each of which takes two passes over the documents
    (counts, then search). Null and empty texts hold no terms: such documents are not found, such
    queries find nothing. Every row counts for itself, repeated ones too: a repeated query (or
    id) is answered again, a repeated document can take several ranks. Long texts are read whole.
    Further columns are ignored, whatever their names; empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    item_type, doc_type = queries.schema[query_id].dataType, docs.schema["doc_id"].dataType
    none = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, "
                                 f"doc_id {doc_type.simpleString()}, score long")
    found = [
        _search_block(spark, docs, block, scratch, k, item_type, doc_type)
        for block in blocks_of(queries, query_id, query_text)
    ]
    out = none
    for number, frame in enumerate(f for f in found if f is not None):
        out = frame if number == 0 else out.unionByName(frame)
    return out


def _search_block(
    spark: SparkSession,
    docs: DataFrame,
    block: QueryBlock,
    scratch: Scratch,
    k: int,
    item_type: T.DataType,
    doc_type: T.DataType,
) -> DataFrame | None:
    from pyspark.sql.pandas.types import to_arrow_schema

    weigh(docs, block, "text")
    if not block.n_terms or not any(block.terms):
        return None
    schema = T.StructType(
        [
            T.StructField("query", T.IntegerType()),
            T.StructField("item_id", item_type),
            T.StructField("doc_id", doc_type),
            T.StructField("score", T.LongType()),
        ]
    )
    to_arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(block)
    partial = docs.select("doc_id", whole("text").cast("binary").alias("text")).mapInArrow(
        lambda batches: _searched(batches, shared.value, k, to_arrow), schema
    )
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = partial.withColumn("salt", F.spark_partition_id() % SALTS)
    of_salt = Window.partitionBy("query", "salt").orderBy(*best_first)
    of_query = Window.partitionBy("query").orderBy(*best_first)
    few = salted.withColumn("rank", F.row_number().over(of_salt)).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
    return scratch.save(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
