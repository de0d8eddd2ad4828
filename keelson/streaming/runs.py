"""A table of newest rows per key that a stream keeps up, as a few runs whose sizes fall.

Every batch becomes a run. It is merged with the runs before it that are less than ``GROWTH`` times as large as all that
came after them, so each kept run is at least that many times larger than the rest behind it. The rows kept are then at most
``1 + 1 / GROWTH`` times those of the largest run, which has one row per key, the runs are as many as the logarithm of the
rows, and a row is rewritten as often as that.

Runs lie in numbered slots. A manifest names the slots in use; the two newest manifests take turns in two folders, so one
is whole at any moment. A slot is overwritten only when neither names it, and emptied as soon as that holds. A batch that is
tried again is merged again, which changes nothing, as the newest row per key is the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.plans.scans import latest_per_key

#: How much larger than all later runs together a run must be to be left alone.
GROWTH = 2

MANIFEST = "version bigint, place int, slot int, rows bigint, state string"
LIVE, PREVIOUS = "live", "previous"


@dataclass
class RunTable:
    """Newest row per ``keys`` by ``order`` below ``path``; ``order`` must be different for the rows of a key."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    order: Sequence[str]

    def _folder(self, slot: int) -> str:
        return f"{self.path}/slot={slot}"

    def manifest(self) -> list:
        """Rows of the newest manifest: live slots from the oldest run on, then those the manifest before it named. None at first."""
        try:
            both = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/turn=*").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = max((r["version"] for r in both), default=None)
        return sorted((r for r in both if r["version"] == newest), key=lambda r: (r["state"], r["place"]))

    def _read(self, slots: list[int]) -> DataFrame:
        if not slots:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(s) for s in slots])

    def current(self) -> DataFrame:
        """Newest row per key. One run needs no grouping."""
        live = [r["slot"] for r in self.manifest() if r["state"] == LIVE]
        rows = self._read(live)
        return rows if len(live) < 2 else latest_per_key(rows, self.keys, self.order)

    def merge(self, batch: DataFrame) -> None:
        """Take a batch in; at most one run is written. An empty batch changes nothing."""
        arrived = batch.select(*self.schema.names).persist()
        try:
            size = arrived.count()
            if size:
                self._merge(arrived, size)
        finally:
            arrived.unpersist()

    def _merge(self, arrived: DataFrame, size: int) -> None:
        known = self.manifest()
        runs = [(r["slot"], r["rows"]) for r in known if r["state"] == LIVE]
        keep = len(runs)
        while keep and runs[keep - 1][1] < GROWTH * size:
            keep -= 1
            size += runs[keep][1]
        merged = [slot for slot, _ in runs[keep:]]
        named = {r["slot"] for r in known}
        slot = next(n for n in range(len(named) + 1) if n not in named)
        seen = Observation()
        newest = latest_per_key(self._read(merged).unionByName(arrived), self.keys, self.order)
        newest.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self._folder(slot))
        version = max((r["version"] for r in known), default=-1) + 1
        live = [*runs[:keep], (slot, seen.get["n"])]
        rows = [(version, n, run, size, LIVE) for n, (run, size) in enumerate(live)]
        rows += [(version, n, run, None, PREVIOUS) for n, run in enumerate(merged)]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/turn={version % 2}")
        # what only the manifest before last could read goes
        for row in known:
            if row["state"] == PREVIOUS:
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self._folder(row["slot"]))
