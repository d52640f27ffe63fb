"""Near copies by SimHash fingerprints, found through an inverted index of their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import component_roots
from panelcast.llm.text import fresh_name, whole
from panelcast.sources.scratch import Scratch

# Parameters of the contract.
SHINGLE = 3
MOST_BITS = 2
SEED = 42

POSITIONS = 8
CHUNK = 16_384


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a text as a long.

    A-Z are lowered, words are runs of characters other than the six ASCII spaces, every shingle
    of ``shingle`` words votes (repeats included, a shorter text with all its words), and a bit is
    set if it is set in over half of the shingles' XXH64 sums. Without words it is zero.
    """

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh64_intdigest

        def of(raw: bytes) -> int:
            words = raw.lower().split()
            if not words:
                return 0
            n = max(1, len(words) - shingle + 1)
            votes = np.zeros(64, dtype=np.int64)
            for start in range(0, n, CHUNK):
                part = words[start : min(start + CHUNK, n) + shingle - 1]
                shifted = [part[i:] for i in range(min(shingle, len(part)))]
                sums = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*shifted))]
                bits = np.array(sums, dtype=">u8").view(np.uint8).reshape(-1, 8)
                votes += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
            return int(np.packbits(votes * 2 > n).view(">i8")[0])

        # Texts leave the batch one by one; a list of them would hold the batch once more.
        for texts in batches:
            yield pa.array((of(raw.as_py()) for raw in texts), pa.int64(), size=len(texts))

    return F.arrow_udf(compute, "long")(whole(text).cast("binary"))


def fingerprint_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(most_bits: int) -> list[int]:
    """One mask for each choice of the positions that two near fingerprints surely share."""
    return [
        _signed(sum(0xFF << (8 * p) for p in kept))
        for kept in combinations(range(POSITIONS), POSITIONS - most_bits)
    ]


def _forest(near: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Of the links between ``n`` places, as few as connect the same places."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in near:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _links(most_bits: int):
    """Verified links of one posting list, as a column function."""
    least_shared = POSITIONS - most_bits

    def near_places(values: np.ndarray) -> list[tuple[int, int]]:
        n = len(values)
        if n <= 256:
            places = values[:, None].view(np.uint8).reshape(n, POSITIONS)
            shared = (places[:, None, :] == places[None, :, :]).sum(axis=2)
            i, j = np.nonzero(np.triu(shared >= least_shared, 1))
            differing = np.bitwise_count(values[i] ^ values[j])
            close = differing <= most_bits
            return list(zip(i[close].tolist(), j[close].tolist()))
        # A longer list is looked up instead of paired: its values agree outside a few bytes, and
        # whatever differs in at most that many bits of those is one of a fixed set of values.
        free = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [1 << b for b in range(64) if free >> b & 1]
        found = []
        for k in range(1, most_bits + 1):
            for flipped in combinations(bits, k):
                other = values ^ np.uint64(sum(flipped))
                at = np.searchsorted(values, other)
                hit = (at < n) & (values[np.minimum(at, n - 1)] == other)
                i = np.nonzero(hit)[0]
                found += [(a, b) for a, b in zip(i.tolist(), at[i].tolist()) if a < b]
        return found

    def links(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            out = []
            for posting in batch:
                values = np.unique(np.asarray(posting, dtype=np.int64).view(np.uint64))
                signed = values.view(np.int64)
                kept = _forest(near_places(values), len(values))
                out.append([(int(signed[i]), int(signed[j])) for i, j in kept])
            yield pd.Series(out)

    return F.pandas_udf(links, "array<struct<u:long,v:long>>")


def near_links(fingerprints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints ``fp`` at most ``most_bits`` bits apart.

    Fingerprints that near share at least ``8 - most_bits`` of their eight bytes in place. The
    index has a posting list for each choice of so many positions and the bytes there; a pair that
    shares so many meets in such a list, where its bits are verified; nothing is tallied. The values of a list differ in ``most_bits`` bytes only, which bounds its length (65,536
    values for two bits) whatever the size of the corpus. Of the links within a list only a
    spanning forest leaves it, so that no group is expanded into all pairs.
    """
    keys = [
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes"))
        for i, mask in enumerate(_masks(most_bits))
    ]
    return (
        fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))
        .groupBy("key.choice", "key.bytes")
        .agg(F.collect_list("fp").alias("posting"))
        .filter(F.size("posting") > 1)
        .select(F.explode(_links(most_bits)("posting")).alias("link"))
        .select("link.u", "link.v")
    )


def near_groups(
    docs: DataFrame,
    scratch: Scratch,
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``most_bits`` differing
    bits. Equal fingerprints are one node of the search, so copies cost nothing there. Null and
    empty texts have fingerprint zero and are linked like any other; null ids count only where a
    group has no other; repeated rows come out repeated; an empty table gives no rows.
    """
    rows = scratch.save(
        docs.select(
            F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")
        ),
        "fingerprints",
    )
    rooted = _rooted(rows, F.min("doc_id").alias("least"), scratch, most_bits)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(groups, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id")


def _rooted(rows: DataFrame, least: Column, scratch: Scratch, most_bits: int) -> DataFrame:
    """``(fp, least, root)``, a row for each fingerprint: the least of its rows, an aggregate named
    ``least``, and its component."""
    classes = scratch.save(rows.groupBy("fp").agg(least), "classes")
    roots = component_roots(near_links(classes, most_bits), scratch)
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def drop_near_copies(
    docs: DataFrame,
    scratch: Scratch,
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One document of each group, the one with the smallest id, in the columns of ``docs``.

    A group is what links connect, whatever its ids: groups without any id, or with the same
    smallest id (an id repeated with unlike texts), keep a document each. Null ids come last; of
    equal ids in a group the one with the smallest fingerprint stays. Repeated rows are copies of
    one another: one of them stays. Which row stays is found by numbers of the rows; the other
    columns are shuffled once, by the join with the numbers that stay, and never aggregated.
    """
    fp, place = fresh_name(docs, "fp"), fresh_name(docs, "place")
    first_place = fresh_name(docs, "first_place")
    marked = scratch.save(
        docs.withColumn(fp, fingerprint_column(F.col(text), shingle)).withColumn(
            place, F.monotonically_increasing_id()
        ),
        "fingerprinted",
    )
    rows = marked.select(
        F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(place).alias("place")
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    first = (
        _rooted(rows, least.alias("least"), scratch, most_bits)
        .groupBy("root")
        .agg(F.min(F.struct("least.no_id", "least.doc_id", "fp", "least.place")).alias("first"))
        .select(F.col("first.place").alias(first_place))
    )
    kept = marked.join(first, F.col(place) == F.col(first_place), "left_semi")
    return kept.drop(fp, place)
