"""SimHash fingerprints of documents, and the search for all within a Hamming radius."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.text import whole
from panelcast.sources.scratch import Scratch

RADIUS = 3
EXTRA_BLOCKS = 3
LONGEST_WEIGHED = 12
TERMS_AT_ONCE = 16_384
ROWS_AT_ONCE = 64


def simhash(raw: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; zero without words.

    Terms are its words, A-Z lowered. The XXH64 sum of a term votes plus or minus the term's
    weight on each bit; the weight grows with the logarithm of the term's count and with its
    length, as short words are common to all texts. Weights are whole numbers, so that the order
    of the terms does not matter.
    """
    from xxhash import xxh64_intdigest

    counts: dict[bytes, int] = {}
    for word in raw.lower().split():
        counts[word] = counts.get(word, 0) + 1
    if not counts:
        return 0
    sums = np.array([xxh64_intdigest(w) for w in counts], dtype=">u8").view(np.uint8).reshape(-1, 8)
    weights = np.array(
        [
            (16 if n == 1 else round(16 * (1 + math.log(n)))) * min(len(w), LONGEST_WEIGHED)
            for w, n in counts.items()
        ],
        dtype=np.float64,
    )
    votes = np.zeros(64)
    for start in range(0, len(weights), TERMS_AT_ONCE):
        part = slice(start, start + TERMS_AT_ONCE)
        votes += weights[part] @ np.unpackbits(sums[part], axis=1).astype(np.float64)
    return int(np.packbits(2 * votes > weights.sum()).view(">i8")[0])


def fingerprint_column(text: Column | str) -> Column:
    """``simhash`` of a text column; null counts as empty."""

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t) for t in texts], dtype="int64")

    return F.pandas_udf(compute, "long")(whole(text).cast("binary"))


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that two fingerprints stand for, from 0 (unrelated or opposed) to 1 (equal)."""
    return F.greatest(F.lit(0.0), F.cos(differing_bits(a, b) * (math.pi / 64)))


def _block_masks(radius: int) -> list[int]:
    """Masks of the leading blocks of each permuted table.

    The 64 bits are cut into ``radius + EXTRA_BLOCKS`` blocks. Differing bits spoil at most
    ``radius`` of them, so some choice of ``EXTRA_BLOCKS`` blocks is equal.
    """
    n = radius + EXTRA_BLOCKS
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    masks = [sum(chosen) for chosen in combinations(blocks, EXTRA_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, indexed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``query_fp, fp`` at most ``radius`` bits apart, each once.

    ``queries`` and ``indexed`` have distinct fingerprints ``fp``. Every table holds all
    fingerprints under the bits of its leading blocks; a pair is verified in the first table that
    brings it together and nowhere else, so a pair in many tables is still one row.
    """
    masks = _block_masks(radius)

    def tabled(frame: DataFrame, name: str, key: str) -> DataFrame:
        keys = [
            F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("lead"))
            for i, m in enumerate(masks)
        ]
        return frame.select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias(key))

    difference = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first_table = F.lit(len(masks))
    for i, mask in reversed(list(enumerate(masks))):
        first_table = F.when(difference.bitwiseAND(F.lit(mask)) == 0, F.lit(i)).otherwise(
            first_table
        )
    met = (
        (F.col("q.table") == F.col("f.table"))
        & (F.col("q.lead") == F.col("f.lead"))
        & (F.bit_count(difference) <= radius)
        & (first_table == F.col("q.table"))
    )
    left = tabled(queries, "query_fp", "q")
    return left.join(tabled(indexed, "fp", "f"), met).select("query_fp", "fp")


FIELDS = (
    "kind string, part int, doc_id {id_type}, n_chars long, edited_sha256 string, fp long, "
    "edited_fp long, next_fp long, text string"
)


def _edited(text: str, following: str) -> tuple[str, int]:
    k = len(text) // 3
    raw = (text[: len(text) - k] + following[:k]).encode()
    return hashlib.sha256(raw).hexdigest(), simhash(raw)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition in one pass: every row with the row behind it.

    The last row lacks its neighbour; it leaves as a ``tail`` with its text, and the first row once
    more as a ``head``, for the partition before. Batches are taken apart a few rows at a time, so that
    little of a partition is in Python's memory at once.
    """
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(start, ROWS_AT_ONCE)
            out = []
            for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist()):
                fp = simhash(text.encode())
                if held is None:
                    out.append(("head", part, doc_id, len(text), None, fp, None, None, text))
                else:
                    before_id, before, before_fp = held
                    sha, edited_fp = _edited(before, text)
                    out.append(
                        ("row", part, before_id, len(before), sha, before_fp, edited_fp, fp, None)
                    )
                held = (doc_id, text, fp)
            if out:
                yield _rows(out, id_type)
    if held is not None:
        doc_id, text, fp = held
        yield _rows([("tail", part, doc_id, len(text), None, fp, None, None, text)], id_type)


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "{id_type}": id_type}
    fields = [field.split() for field in FIELDS.split(", ")]
    columns = [pa.array(c, types[kind]) for c, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _finish(text: pd.Series, following: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [_edited(a, b) for a, b in zip(text, following)], columns=["sha", "edited_fp"]
    )


def edited_with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each document with its edited text, whose last third is the start of the next document's.

    The next document is the one of the next smaller ``doc_id`` (nulls last, rows of one id by
    their text), after the last one the first. Returns ``doc_id, n_chars, edited_sha256, fp,
    edited_fp, next_fp`` per row, with ids of the type they have; further columns are left out. Null
    texts count as empty, a single row is its own neighbour, an empty table gives no rows.

    Texts move once, to range partitions of the id; each partition is one pass that holds two
    texts at a time. Only the first and last row of each partition meet in a second step.
    """
    rows = docs.select("doc_id", whole("text").alias("text")).withColumns(
        {"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    )
    order = [F.col("doc_id").desc_nulls_last(), "tie", "row"]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    along = scratch.save(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_along, FIELDS.format(id_type=id_type)),
        "edited",
    )
    results = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
    heads = along.filter("kind = 'head'").select(
        F.col("part").alias("head_part"),
        F.col("text").alias("head_text"),
        F.col("fp").alias("head_fp"),
    )
    # One number for each partition.
    parts = along.filter("kind = 'head'").select("part")
    by_part = Window.orderBy("part")
    everywhere = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = parts.select(
        "part",
        F.coalesce(F.lead("part").over(by_part), F.min("part").over(everywhere)).alias(
            "head_part"
        ),
    )
    finish = F.pandas_udf(_finish, "sha string, edited_fp long")
    tails = (
        along.filter("kind = 'tail'")
        .join(follows, "part")
        .join(heads, "head_part")
        .withColumn("done", finish("text", "head_text"))
        .select(
            "doc_id",
            "n_chars",
            F.col("done.sha").alias("edited_sha256"),
            "fp",
            F.col("done.edited_fp").alias("edited_fp"),
            F.col("head_fp").alias("next_fp"),
        )
    )
    return along.filter("kind = 'row'").select(*results).unionByName(tails)


def count_near(fingerprints: DataFrame, queries: Column, radius: int = RADIUS) -> DataFrame:
    """All rows of ``fingerprints`` with ``n_near``: for rows where ``queries`` holds the number of
    rows within ``radius`` bits of ``fp`` (the row itself included), null for the others."""
    classes = fingerprints.groupBy("fp").agg(F.count("*").alias("copies"))
    asked = F.coalesce(queries, F.lit(False))
    wanted = fingerprints.filter(asked)
    near = within_radius(wanted.select("fp").distinct(), classes.select("fp"), radius)
    counts = (
        near.join(classes, "fp")
        .groupBy("query_fp")
        .agg(F.sum("copies").alias("n_near"))
        .withColumnRenamed("query_fp", "fp")
    )
    others = fingerprints.filter(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return wanted.join(counts, "fp").select(*others.columns).unionByName(others)
