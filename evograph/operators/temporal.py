"""Time travel over an append-only log of updates (version, seq, src, dst, add, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans import fixpoint
from .graph import UpdateBatch, highest_id, snapshot


class TemporalGraph:
    """Every batch is kept; a snapshot is one filtered scan and one aggregate, in arrival order."""

    def __init__(self, spark: SparkSession, n: int = 0, directed: bool = False):
        self.spark, self.initial, self.directed, self.version = spark, n, directed, 0
        self.log = spark.createDataFrame([], schema.UPDATES)

    @classmethod
    def over(cls, log: DataFrame, directed: bool = False, n: int = 0) -> TemporalGraph:
        g = cls(log.sparkSession, n, directed)
        g.log, g.version = log, log.agg(F.max("version")).first()[0] or 0
        return g

    def apply(self, batch: UpdateBatch) -> None:
        if len(batch):
            self.version += 1
            self.log = fixpoint.cut(self.log.unionByName(batch.frame(self.spark, self.version)))

    def _known(self, *versions: int) -> None:
        if any(v > self.version or v < 0 for v in versions):
            raise ValueError("no such version")

    def snapshot_version(self, version: int) -> DataFrame:
        self._known(version)
        return snapshot(self.log.where(F.col("version") <= version), self.directed)

    def snapshot_time(self, t: int) -> DataFrame:
        """Operations stamped up to ``t``, replayed in the order of arrival, not of their stamps."""
        return snapshot(self.log.where(F.col("ts") <= t), self.directed)

    def vertex_count(self, updates: DataFrame) -> int:
        """The initial count, grown by the replayed operations only."""
        return max(self.initial, highest_id(updates) + 1)

    def changes_between_versions(self, start: int, end: int) -> DataFrame:
        """Raw operations of versions in (start, end], in order."""
        self._known(start, end)
        if start > end:
            raise ValueError("versions are inverted")
        return self.log.where((F.col("version") > start) & (F.col("version") <= end)).orderBy("version", "seq")

    def changes_between_times(self, start: int, end: int) -> DataFrame:
        """Raw operations stamped in (start, end], in order of arrival."""
        if start > end:
            raise ValueError("times are inverted")
        return self.log.where((F.col("ts") > start) & (F.col("ts") <= end)).orderBy("version", "seq")

    def sliding_window(self, end: int, width: int) -> DataFrame:
        """The graph of the operations stamped in (max(0, end - width), end] alone; what came before is forgotten."""
        begin = max(0, end - width)
        return snapshot(self.log.where((F.col("ts") > begin) & (F.col("ts") <= end)), self.directed)

    def history(self) -> DataFrame:
        return self.log.groupBy("version").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n_ops"))
