"""Weighted graphs: the last weight of each edge of an ordered log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans import fixpoint
from .graph import canonical, highest_id, oriented


@dataclass
class WeightedUpdateBatch:
    rows: list[tuple[int, int, int, bool, int]] = field(default_factory=list)

    def add(self, src: int, dst: int, weight: int = 1, ts: int = 0) -> WeightedUpdateBatch:
        self.rows.append((src, dst, weight, True, ts))
        return self

    #: Setting a weight is the same operation as adding the edge.
    update = add

    def remove(self, src: int, dst: int, ts: int = 0) -> WeightedUpdateBatch:
        self.rows.append((src, dst, 1, False, ts))
        return self

    def __len__(self) -> int:
        return len(self.rows)

    def frame(self, spark: SparkSession, version: int = 0) -> DataFrame:
        return schema.updates_frame(spark, [(version, k, *r) for k, r in enumerate(self.rows)], schema.WEIGHTED_UPDATES)


def weighted_snapshot(updates: DataFrame, directed: bool) -> DataFrame:
    """Arcs (src, dst, w) of a weighted log."""
    last = canonical(updates, directed, ("weight",)).where("add").select("src", "dst", F.col("weight").alias("w"))
    return oriented(last, directed)


class WeightedGraph:
    def __init__(self, spark: SparkSession, n: int = 0, directed: bool = False):
        self.spark, self.n, self.directed, self.version = spark, n, directed, 0
        self._arcs = spark.createDataFrame([], "src long, dst long, w long")

    def frame(self, batch: WeightedUpdateBatch | DataFrame) -> DataFrame:
        return batch.frame(self.spark, self.version) if isinstance(batch, WeightedUpdateBatch) else batch

    def check(self, updates: DataFrame) -> None:
        """Reject the whole batch, before anything changes, if an added weight is out of range."""
        bad = updates.where("add and src <> dst").where((F.col("weight") < 0) | (F.col("weight") >= schema.INFINITY) | F.col("weight").isNull())
        if not bad.isEmpty():
            raise ValueError("edge weight out of range")

    def apply(self, batch: WeightedUpdateBatch | DataFrame) -> None:
        updates = self.frame(batch)
        if updates.isEmpty():
            return
        self.check(updates)
        self.n = max(self.n, highest_id(updates) + 1)
        new = oriented(canonical(updates, self.directed, ("weight",)), self.directed)
        kept = self._arcs.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        self._arcs = fixpoint.cut(kept.unionByName(new.where("add").select("src", "dst", F.col("weight").alias("w"))))
        self.version += 1

    def arcs(self) -> DataFrame:
        return self._arcs.select("src", "dst")

    def weighted_arcs(self) -> DataFrame:
        return self._arcs

    def vertices(self) -> DataFrame:
        return schema.vertices(self.spark, self.n)

    def weight(self, u: int, v: int) -> int | None:
        row = self._arcs.where((F.col("src") == u) & (F.col("dst") == v)).first()
        return None if row is None else row.w

    def degree(self, u: int) -> int:
        return self._arcs.where(F.col("src") == u).count()

    def neighbors(self, u: int) -> list[tuple[int, int]]:
        return [(r.dst, r.w) for r in self._arcs.where(F.col("src") == u).orderBy("dst").collect()]
