"""The catalog of all possible series: the product of the dimension lists."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.ordinals import number_members
from panelcast.functions.sizes import ROW_OVERHEAD, broadcast_if_small
from panelcast.operators.calendar import attach_period
from panelcast.schema import KEYS
from panelcast.sources.scratch import Scratch


def dimension_members(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Number lists ``(dim, value)`` that bring no order of their own."""
    return scratch.save(number_members(lists, scratch), "dimensions")


def observed_members(
    facts: DataFrame, scratch: Scratch, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Dimension lists made of the values that occur in ``facts``.

    Unfolded first: partial distinct then leaves each task no more rows than there are values.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("dim"), F.col(k).alias("value")) for k in keys])
    )
    members = facts.select(pairs.alias("pair")).select("pair.*")
    return dimension_members(members.filter(F.col("value").isNotNull()).distinct(), scratch)


def distinct_series(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return facts.select(*keys).distinct()


def filter_series(facts: DataFrame, **values: str) -> DataFrame:
    """Facts of one series, given as ``key=value``."""
    for key, value in values.items():
        facts = facts.filter(F.col(key) == value)
    return facts


@dataclass(frozen=True)
class Catalog:
    """Dimension lists with their sizes.

    A series number is the mixed-radix number of its list positions, first list most
    significant: the row order of a left-major cross join. So series are numbered, and numbers
    turned back to keys, by arithmetic and equi-joins on lists; no product of frames and no
    table of all series takes part in a join.
    """

    lists: DataFrame
    sizes: dict[str, int]
    n_bytes: dict[str, int]

    @classmethod
    def of(cls, lists: DataFrame, keys: Sequence[str] = KEYS) -> Catalog:
        """Measure ``(dim, value, ord)`` lists and reject unusable ones."""
        rows = (
            lists.groupBy("dim")
            .agg(
                F.count("*").alias("n"),
                F.countDistinct(F.struct("value")).alias("n_values"),
                F.countDistinct("ord").alias("n_ords"),
                F.min("ord").alias("low"),
                F.max("ord").alias("high"),
                F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + ROW_OVERHEAD).alias("size"),
            )
            .filter(F.col("dim").isin(*keys))
            .collect()
        )
        found = {row["dim"]: row for row in rows}
        for key in keys:
            row = found.get(key)
            if row is None:
                raise ValueError(f"dimension list {key} is empty")
            if row["n_values"] != row["n"]:
                raise ValueError(f"dimension list {key} holds duplicates")
            if (row["n_ords"], row["low"], row["high"]) != (row["n"], 0, row["n"] - 1):
                raise ValueError(f"dimension list {key} is not numbered 0..n-1")
        return cls(
            lists,
            {key: found[key]["n"] for key in keys},
            {key: found[key]["size"] for key in keys},
        )

    @property
    def keys(self) -> list[str]:
        return list(self.sizes)

    @property
    def n_series(self) -> int:
        return math.prod(self.sizes.values())

    def members(self, key: str) -> DataFrame:
        """One list as ``(<key>, <key>_ord)``."""
        one = self.lists.filter(F.col("dim") == key).select(
            F.col("value").alias(key), F.col("ord").alias(f"{key}_ord")
        )
        return broadcast_if_small(one, self.n_bytes[key])

    def restricted(self, *keys: str) -> Catalog:
        return Catalog(
            self.lists, {k: self.sizes[k] for k in keys}, {k: self.n_bytes[k] for k in keys}
        )

    def _stride(self, key: str) -> int:
        return math.prod(self.sizes[k] for k in self.keys[self.keys.index(key) + 1 :])

    def _number(self) -> Column:
        terms = [F.col(f"{k}_ord").cast("long") * F.lit(self._stride(k)) for k in self.keys]
        number = terms[0]
        for term in terms[1:]:
            number = number + term
        return number

    def encode(self, frame: DataFrame) -> DataFrame:
        """Replace the keys by ``series_id``; rows outside the catalog, null keys included, go."""
        for key in self.keys:
            frame = frame.join(self.members(key), key)
        ords = [f"{k}_ord" for k in self.keys]
        return frame.withColumn("series_id", self._number()).drop(*self.keys, *ords)

    def decode(self, frame: DataFrame) -> DataFrame:
        """Left-join the keys of every ``series_id``."""
        for key in self.keys:
            place = F.expr(f"series_id div {self._stride(key)}L % {self.sizes[key]}L")
            frame = (
                frame.withColumn(f"{key}_ord", place.cast("int"))
                .join(self.members(key), f"{key}_ord", "left")
                .drop(f"{key}_ord")
            )
        return frame

    def ids(self) -> DataFrame:
        """All series numbers, generated where they are used."""
        return self.lists.sparkSession.range(self.n_series).withColumnRenamed("id", "series_id")

    def series(self) -> DataFrame:
        """Every series: ``(series_id, <keys>)``."""
        return self.decode(self.ids()).select("series_id", *self.keys)

    def orphans(self, facts: DataFrame) -> DataFrame:
        """Facts outside the catalog: those with a key that is missing from its list.

        The catalog is a full product, so four small list lookups replace an anti-join of the
        facts with all series.
        """
        columns = facts.columns
        for key in self.keys:
            facts = facts.join(self.members(key), key, "left")
        outside = F.lit(False)
        for key in self.keys:
            outside = outside | F.col(f"{key}_ord").isNull()
        return facts.filter(outside).select(*columns)


def cross_join(catalog: Catalog, *keys: str) -> DataFrame:
    """All combinations of some of the lists, left-major."""
    return catalog.restricted(*keys).series().select(*keys)


def relabel_series(frame: DataFrame, catalog: Catalog, spine: DataFrame) -> DataFrame:
    """Swap ``series_id`` for the business keys and add the period end."""
    labelled = attach_period(catalog.decode(frame), spine)
    measures = [c for c in frame.columns if c not in ("series_id", "month")]
    return labelled.select("month", "period_end", *catalog.keys, *measures)
