"""Monthly sums kept batch by batch, so that late facts are added and history is not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.grid import label_sums, period_sums
from panelcast.schema import KEYS, MEASURES, history_schema
from panelcast.sources.folders import delete_folder, names_in

SUM = T.DecimalType(38, 4)
BATCH, UPTO = "batch=", "upto="
HISTORY_BATCH = "batch_id="
# Fixed value: the file that Spark writes into a folder last.
DONE = "_SUCCESS"


class SumStore:
    """Sums by key and period label under ``path``: one folder per batch of facts (``batch=N``), and
    folders that hold all batches up to one (``upto=N``).

    Sums are exact decimals, so it does not matter in which batches facts came, nor how often sums
    were merged. A folder counts once it is complete; until then, and if its writer fails, readers see
    what was there before. A repeated batch replaces itself. Sums have a row per batch, series and
    label, whatever the number of facts.
    """

    def __init__(self, spark: SparkSession, path: str, measures: Sequence[str] = MEASURES):
        self.spark, self.path = spark, path.rstrip("/")
        self.measures = list(measures)
        self.schema = T.StructType(
            [T.StructField(c, T.StringType()) for c in (*KEYS, "periode")]
            + [T.StructField(m, SUM) for m in self.measures]
        )

    def _complete(self, prefix: str) -> list[int]:
        """Numbers of the complete folders of a kind."""
        numbers = [n for n in names_in(self.spark, self.path) if n.startswith(prefix)]
        return sorted(
            int(n.removeprefix(prefix))
            for n in numbers
            if DONE in names_in(self.spark, f"{self.path}/{n}")
        )

    def _current(self) -> tuple[int | None, list[int]]:
        """The last merged batch, if any, and the batches behind it."""
        merged = self._complete(UPTO)
        upto = merged[-1] if merged else None
        return upto, [b for b in self._complete(BATCH) if upto is None or b > upto]

    def _write(self, sums: DataFrame, folder: str) -> None:
        exact = [F.col(m).cast(SUM).alias(m) for m in self.measures]
        sums.select(*KEYS, "periode", *exact).write.mode("overwrite").parquet(
            f"{self.path}/{folder}"
        )

    def put(self, facts: DataFrame, batch: int) -> None:
        """Add a batch of facts, or replace it."""
        self._write(label_sums(facts, measures=self.measures), f"{BATCH}{batch}")

    def catch_up(self, history_path: str) -> list[int]:
        """Add the batches of a stored history that are not in yet, and return their numbers. Only
        the partitions of these batches are read."""
        upto, batches = self._current()
        stored = [
            int(name.removeprefix(HISTORY_BATCH))
            for name in names_in(self.spark, history_path)
            if name.startswith(HISTORY_BATCH)
        ]
        new = sorted(b for b in stored if b not in batches and (upto is None or b > upto))
        for batch in new:
            facts = self.spark.read.schema(history_schema(self.measures)).parquet(
                f"{history_path.rstrip('/')}/{HISTORY_BATCH}{batch}"
            )
            self.put(facts, batch)
        return new

    def _parts(self) -> DataFrame:
        upto, batches = self._current()
        folders = [] if upto is None else [f"{self.path}/{UPTO}{upto}"]
        folders += [f"{self.path}/{BATCH}{b}" for b in batches]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f) for f in folders]
        merged = parts[0]
        for other in parts[1:]:
            merged = merged.unionByName(other)
        return merged

    def merged(self) -> DataFrame:
        """What ``monthly_sums`` gives for all facts so far."""
        return period_sums(self._parts(), measures=self.measures)

    def compact(self) -> None:
        """Merge all batches into one folder, and remove what an earlier merge had made needless.

        What this merge replaces stays until the next one, for readers that have begun.
        """
        upto, batches = self._current()
        if not batches:
            return
        before = self._complete(BATCH), self._complete(UPTO)
        self._write(label_sums(self._parts(), measures=self.measures), f"{UPTO}{batches[-1]}")
        if upto is not None:
            needless = [f"{BATCH}{b}" for b in before[0] if b <= upto]
            needless += [f"{UPTO}{b}" for b in before[1] if b < upto]
            for folder in needless:
                delete_folder(self.spark, f"{self.path}/{folder}")
