"""Graph state: an ordered log of updates folded into a base and an overlay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans import fixpoint


@dataclass
class UpdateBatch:
    """An ordered batch of edge operations, for callers that have them in memory."""

    rows: list[tuple[int, int, bool, int]] = field(default_factory=list)

    def add(self, src: int, dst: int, ts: int = 0) -> UpdateBatch:
        self.rows.append((src, dst, True, ts))
        return self

    def remove(self, src: int, dst: int, ts: int = 0) -> UpdateBatch:
        self.rows.append((src, dst, False, ts))
        return self

    def __len__(self) -> int:
        return len(self.rows)

    def frame(self, spark: SparkSession, version: int = 0) -> DataFrame:
        return schema.updates_frame(spark, [(version, k, *r) for k, r in enumerate(self.rows)])


def canonical(updates: DataFrame, directed: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """The last operation on each edge, loops dropped: (src, dst, add, *extra) with one orientation if undirected.

    Order is (version, seq).  One aggregate, partial before the shuffle.
    """
    a, b = schema.pair_key(directed)
    order = F.struct("version", "seq")
    kept = updates.where("src <> dst").select(a.alias("src"), b.alias("dst"), "version", "seq", "add", *extra)
    return kept.groupBy("src", "dst").agg(F.max_by("add", order).alias("add"), *(F.max_by(c, order).alias(c) for c in extra))


def oriented(edges: DataFrame, directed: bool) -> DataFrame:
    return edges if directed else schema.symmetric(edges)


def highest_id(updates: DataFrame) -> int:
    """The largest id of a non-loop operation, removals of absent edges included; -1 if there is none."""
    top = updates.where("src <> dst").agg(F.max(F.greatest("src", "dst")).alias("n")).first().n
    return -1 if top is None else int(top)


def snapshot(updates: DataFrame, directed: bool) -> DataFrame:
    """Arcs (src, dst) of a log replayed in arrival order onto an empty graph."""
    return oriented(canonical(updates, directed).where("add").select("src", "dst"), directed)


class Graph:
    """A mutable simple graph: base arcs, an overlay of effective differences, a vertex count and a version."""

    def __init__(self, spark: SparkSession, n: int = 0, directed: bool = False):
        self.spark, self.n, self.directed, self.version = spark, n, directed, 0
        self.base = spark.createDataFrame([], "src long, dst long")
        self.overlay = spark.createDataFrame([], "src long, dst long, add boolean")

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, n: int | None = None) -> Graph:
        g = cls(edges.sparkSession, n or 0, directed)
        g.bulk_load(edges)
        return g

    def bulk_load(self, edges: DataFrame) -> None:
        """Replace all contents by ``edges``; the vertex count never falls."""
        kept = edges.select(schema.checked_id(F.col("src")).alias("src"), schema.checked_id(F.col("dst")).alias("dst"))
        self.base = fixpoint.cut(schema.simple_arcs(kept, self.directed))
        self.overlay = self.spark.createDataFrame([], "src long, dst long, add boolean")
        self.n = max(self.n, (self.base.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1 if not self.base.isEmpty() else 0)
        self.version += 1

    def ensure_vertex(self, v: int) -> None:
        self.n = max(self.n, v + 1)

    def add_edge(self, u: int, v: int) -> None:
        self.apply(UpdateBatch().add(u, v))

    def remove_edge(self, u: int, v: int) -> None:
        self.apply(UpdateBatch().remove(u, v))

    def frame(self, batch: UpdateBatch | DataFrame) -> DataFrame:
        return batch.frame(self.spark, self.version) if isinstance(batch, UpdateBatch) else batch

    def apply(self, batch: UpdateBatch | DataFrame) -> None:
        """Apply operations in order; a non-empty batch is one version.  Entries that restore the base vanish from the overlay."""
        if isinstance(batch, UpdateBatch) and not len(batch) or isinstance(batch, DataFrame) and batch.isEmpty():
            return
        updates = self.frame(batch)
        self.n = max(self.n, highest_id(updates) + 1)
        new = oriented(canonical(updates, self.directed), self.directed)
        last = self.overlay.withColumn("_k", F.lit(0)).unionByName(new.withColumn("_k", F.lit(1))).groupBy("src", "dst").agg(F.max_by("add", "_k").alias("add"))
        self.overlay = fixpoint.cut(effective(last, self.base))
        self.version += 1

    def arcs(self) -> DataFrame:
        """Logical arcs (src, dst): base without removed, and added ones."""
        gone = self.overlay.where("not add").select("src", "dst")
        return self.base.join(gone, ["src", "dst"], "left_anti").unionByName(self.overlay.where("add").select("src", "dst"))

    def vertices(self) -> DataFrame:
        return schema.vertices(self.spark, self.n)

    def neighbors(self, u: int) -> list[int]:
        return [r.dst for r in self.arcs().where(F.col("src") == u).orderBy("dst").collect()]

    def in_neighbors(self, v: int) -> list[int]:
        return [r.src for r in self.arcs().where(F.col("dst") == v).orderBy("src").collect()]

    def checked_neighbors(self, u: int) -> list[int]:
        """As :meth:`neighbors`, but an id out of range is an error, as for static graphs."""
        if not 0 <= u < self.n:
            raise IndexError(f"no vertex {u}")
        return self.neighbors(u)

    def has_edge(self, u: int, v: int) -> bool:
        return not self.arcs().where((F.col("src") == u) & (F.col("dst") == v)).isEmpty()

    def degree(self, u: int) -> int:
        return self.arcs().where(F.col("src") == u).count()

    def edge_entry_count(self) -> int:
        return self.arcs().count()

    def delta_edge_count(self) -> int:
        return self.overlay.count()

    def delta_ratio(self) -> float:
        return self.delta_edge_count() / max(1, self.base.count())

    def dirty_rows(self) -> int:
        return self.overlay.select("src").distinct().count()

    def digest(self) -> tuple[int, int]:
        """(arcs, xor of arc hashes): equal for equal adjacency, whatever its layout."""
        row = self.arcs().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)).alias("x")).first()
        return row.n, row.x

    def compact(self) -> None:
        """Fold the overlay into the base; nothing that can be observed changes."""
        self.base, self.overlay = fixpoint.cut(self.arcs()), self.spark.createDataFrame([], "src long, dst long, add boolean")

    def maybe_compact(self, threshold: float = 0.25) -> int:
        """Fold the rows whose overlay is dense, and return how many there were."""
        rows = fixpoint.cut(compaction_candidates(self.base, self.overlay, threshold).select("src"))
        if count := rows.count():
            mine, others = self.overlay.join(rows, "src", "left_semi"), self.overlay.join(rows, "src", "left_anti")
            base = self.base.join(mine.where("not add"), ["src", "dst"], "left_anti").unionByName(mine.where("add").select("src", "dst"))
            self.base, self.overlay = fixpoint.cut(base), fixpoint.cut(others)
        return count

    def maintain(self, entries: int = 65_536, ratio: float = 0.01) -> int:
        """Automatic maintenance: with enough overlay entries at enough of the base, compact rows from density 0.50."""
        delta = self.delta_edge_count()
        return self.maybe_compact(0.50) if delta >= entries and delta / max(1, self.base.count()) >= ratio else 0

    def consolidated(self) -> Graph:
        """A fresh graph with the same logical arcs and no overlay; this one is left as it is."""
        fresh = Graph(self.spark, self.n, self.directed)
        fresh.base, fresh.version = fixpoint.cut(self.arcs().repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")), self.version
        return fresh


def effective(overlay: DataFrame, base: DataFrame) -> DataFrame:
    """Overlay entries that change ``base``: additions of absent arcs, removals of present ones."""
    added = overlay.where("add").join(base, ["src", "dst"], "left_anti")
    return added.unionByName(overlay.where("not add").join(base, ["src", "dst"], "left_semi"))


def compaction_candidates(base: DataFrame, overlay: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(src, overlay_entries, base_entries, density) of rows with density overlay / max(8, base) at the threshold or above."""
    o = overlay.groupBy("src").agg(F.count(F.lit(1)).alias("overlay_entries"))
    b = base.join(o.select("src"), "src", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("base_entries"))
    rows = o.join(b, "src", "left").withColumn("base_entries", F.coalesce("base_entries", F.lit(0)))
    return rows.withColumn("density", F.col("overlay_entries") / F.greatest(F.lit(8), F.col("base_entries"))).where(F.col("density") >= threshold)


def degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def neighbor_lists(arcs: DataFrame) -> DataFrame:
    """(v, neighbors): each vertex's sorted neighbours."""
    return arcs.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
