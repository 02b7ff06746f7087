"""Analytics that are kept up to date after each batch, by repair or by full recomputation.

Each class applies a batch to its graph and then holds what a fresh computation would give.  Region
sizes and flags say which way it went.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans import blocks, fixpoint
from . import components, kcore, pagerank, similarity, traversal
from .graph import Graph, UpdateBatch, canonical, degrees, oriented
from .weighted import WeightedGraph, WeightedUpdateBatch

Batch = UpdateBatch | DataFrame


def effective_changes(graph: Graph, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, deleted) arcs that really change the graph, before it is mutated."""
    last = oriented(canonical(updates, graph.directed), graph.directed)
    now = graph.arcs()
    inserted = last.where("add").select("src", "dst").join(now, ["src", "dst"], "left_anti")
    deleted = last.where("not add").select("src", "dst").join(now, ["src", "dst"], "left_semi")
    return fixpoint.cut(inserted), fixpoint.cut(deleted)


def _unit(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "dst", F.lit(1).cast("long").alias("w"))


class IncrementalBFS:
    """Hop distances from one source.  A deletion invalidates a vertex only when all its shortest parents are lost."""

    def __init__(self, graph: Graph, source: int, fallback: float = 0.35):
        self.graph, self.source, self.fallback = graph, source, fallback
        self.last_deletion_candidates = self.last_affected_vertices = 0
        self.last_used_full_recompute = False
        self.recompute()

    def recompute(self) -> None:
        empty = self.graph.spark.createDataFrame([], "v long, d long")
        start = self.graph.spark.createDataFrame([(self.source,)], "v long")
        self.dist = traversal.bfs(self.graph.arcs(), start) if 0 <= self.source < self.graph.n else empty

    @property
    def distances(self) -> DataFrame:
        """(v, d) for all vertices, ``UNREACHABLE`` where no path leads."""
        return traversal.with_sentinel(self.graph.vertices(), self.dist, schema.UNREACHABLE)

    @property
    def reachable_count(self) -> int:
        return self.dist.count()

    def affected(self, deleted: DataFrame) -> tuple[DataFrame, bool]:
        """(vertices whose support is lost, whether they exceed the limit), on the graph before the batch.

        Support arcs lead from d to d + 1, so one pass a level settles everything; the loop ends where no vertex loses all of its parents.
        """
        spark, limit = self.graph.spark, max(1, int(self.graph.n * self.fallback))
        d = self.dist
        parents = self.graph.arcs().join(d.toDF("src", "_du"), "src").join(d.toDF("dst", "_dv"), "dst").where("_du + 1 = _dv").select("src", "dst")
        parents = fixpoint.cut(parents)
        lost = fixpoint.cut(parents.join(deleted, ["src", "dst"], "left_semi"))
        self.last_deletion_candidates = lost.select("dst").distinct().count()
        gone = spark.createDataFrame([], "v long")
        while True:
            # Of the vertices that lost an arc, those all of whose parent arcs are lost.
            heads = lost.select("dst").distinct()
            total = parents.join(heads, "dst", "left_semi").groupBy("dst").agg(F.count(F.lit(1)).alias("_all"))
            dead = total.join(lost.groupBy("dst").agg(F.count(F.lit(1)).alias("_lost")), "dst").where("_lost >= _all").select(F.col("dst").alias("v"))
            new = fixpoint.cut(dead.join(gone, "v", "left_anti"))
            size = new.count()
            if not size:
                return gone, False
            gone = fixpoint.cut(gone.unionByName(new))
            if gone.count() > limit:
                return gone, True
            lost = fixpoint.cut(lost.unionByName(parents.join(fixpoint.sized(new.withColumnRenamed("v", "src"), size), "src", "left_semi")).distinct())

    def apply(self, batch: Batch) -> None:
        updates = self.graph.frame(batch)
        had = self.graph.n
        inserted, deleted = effective_changes(self.graph, updates)
        gone, too_many = self.affected(deleted)
        self.last_affected_vertices, self.last_used_full_recompute = gone.count(), too_many
        self.graph.apply(batch)
        if too_many or had <= self.source < self.graph.n:
            return self.recompute()
        kept = self.dist.join(gone, "v", "left_anti")
        arcs = self.graph.arcs()
        # What the rest of the graph offers to affected vertices, and what insertions offer to any.
        edge = arcs.join(gone.withColumnRenamed("v", "dst"), "dst", "left_semi").unionByName(inserted).distinct()
        offers = edge.join(kept.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg((F.min("d") + 1).alias("_n"))
        seeds = fixpoint.cut(offers.join(kept, "v", "left").where("d is null or _n < d").select("v", F.col("_n").alias("d")))
        start = kept.unionByName(seeds).groupBy("v").agg(F.min("d").alias("d"))
        self.dist = fixpoint.relax(start, seeds, _unit(arcs))[0]


class IncrementalSSSP:
    """Unweighted shortest paths: insertions relax, any removal in a batch recomputes."""

    def __init__(self, graph: Graph, source: int):
        self.graph, self.source, self.last_used_full_recompute = graph, source, False
        self.recompute()

    def recompute(self) -> None:
        empty = self.graph.spark.createDataFrame([], "v long, d long")
        self.dist = traversal.shortest_paths(_unit(self.graph.arcs()), self.source) if 0 <= self.source < self.graph.n else empty

    @property
    def distances(self) -> DataFrame:
        return traversal.with_sentinel(self.graph.vertices(), self.dist, schema.INFINITY)

    def apply(self, batch: Batch) -> None:
        updates, had = self.graph.frame(batch), self.graph.n
        removal = not updates.where("not add").isEmpty()
        inserted, _ = effective_changes(self.graph, updates)
        self.graph.apply(batch)
        self.last_used_full_recompute = removal
        if removal or had <= self.source < self.graph.n:
            return self.recompute()
        self.dist = _relaxed(self.dist, _unit(inserted), _unit(self.graph.arcs()))


def _relaxed(dist: DataFrame, offered: DataFrame, arcs: DataFrame) -> DataFrame:
    offers = offered.join(dist.withColumnRenamed("v", "src"), "src").where(F.col("w") < F.lit(schema.INFINITY) - F.col("d"))
    best = offers.groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("_n"))
    seeds = fixpoint.cut(best.join(dist, "v", "left").where("d is null or _n < d").select("v", F.col("_n").alias("d")))
    start = dist.unionByName(seeds).groupBy("v").agg(F.min("d").alias("d"))
    return blocks.relax(start, seeds, arcs, schema.INFINITY - 1)


class IncrementalWeightedSSSP:
    """Weighted shortest paths: only deletions and increases of existing edges recompute."""

    def __init__(self, graph: WeightedGraph, source: int):
        self.graph, self.source, self.last_used_full_recompute = graph, source, False
        self.recompute()

    def recompute(self) -> None:
        empty = self.graph.spark.createDataFrame([], "v long, d long")
        self.dist = traversal.shortest_paths(self.graph.weighted_arcs(), self.source) if 0 <= self.source < self.graph.n else empty

    @property
    def distances(self) -> DataFrame:
        return traversal.with_sentinel(self.graph.vertices(), self.dist, schema.INFINITY)

    def apply(self, batch: WeightedUpdateBatch | DataFrame) -> None:
        updates, had = self.graph.frame(batch), self.graph.n
        self.graph.check(updates)
        last = oriented(canonical(updates, self.graph.directed, ("weight",)), self.graph.directed)
        old = self.graph.weighted_arcs().withColumnRenamed("w", "_old")
        worse = not last.join(old, ["src", "dst"]).where("not add or weight > _old").isEmpty()
        offered = fixpoint.cut(last.where("add").select("src", "dst", F.col("weight").alias("w")))
        self.graph.apply(batch)
        self.last_used_full_recompute = worse
        if worse or had <= self.source < self.graph.n:
            return self.recompute()
        self.dist = _relaxed(self.dist, offered, self.graph.weighted_arcs())


class IncrementalComponents:
    """Labels, the smallest vertex of each component.  Only components that lose an edge are rebuilt; insertions then merge labels."""

    def __init__(self, graph: Graph):
        schema.undirected_only(graph.directed, "connected components")
        self.graph, self.last_repaired_vertices = graph, 0
        self.recompute()

    def recompute(self) -> None:
        self.labels = fixpoint.cut(components.min_labels(self.graph.arcs(), self.graph.vertices()))

    def component(self, v: int) -> int:
        return self.labels.where(F.col("v") == v).first().component

    def apply(self, batch: Batch) -> None:
        inserted, deleted = effective_changes(self.graph, self.graph.frame(batch))
        hit = self.labels.join(deleted.select(F.col("src").alias("v")).distinct(), "v", "left_semi").select("component").distinct()
        region = fixpoint.cut(self.labels.join(hit, "component", "left_semi").select("v"))
        self.last_repaired_vertices = region.count()
        before = self.graph.n
        self.graph.apply(batch)
        labels = self.labels.unionByName(self.graph.vertices().where(F.col("v") >= before).select("v", F.col("v").alias("component")))
        if self.last_repaired_vertices:
            inside = self.graph.arcs().join(inserted, ["src", "dst"], "left_anti").join(region.withColumnRenamed("v", "src"), "src", "left_semi")
            labels = labels.join(region, "v", "left_anti").unionByName(components.min_labels(inside, region))
        labels = fixpoint.cut(labels)
        # Insertions join whole components: solve the graph of labels, then rename.
        ends = inserted.where("src < dst").join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        ends = fixpoint.cut(ends)
        if not ends.isEmpty():
            touched = ends.select(F.col("src").alias("v")).unionByName(ends.select(F.col("dst").alias("v"))).distinct()
            renamed = components.min_labels(ends, touched).toDF("component", "_new")
            labels = fixpoint.cut(labels.join(renamed, "component", "left").select("v", F.coalesce("_new", "component").alias("component")))
        self.labels = labels


class IncrementalTriangleCount:
    """The number of triangles, changed by those that hold a deleted edge before the batch or an inserted one after it."""

    def __init__(self, graph: Graph, initial: int | None = None):
        schema.undirected_only(graph.directed, "the triangle count")
        self.graph = graph
        self.value = initial if initial is not None else similarity.triangle_count(graph.arcs()).first().triangles

    def recompute(self) -> None:
        self.value = similarity.triangle_count(self.graph.arcs()).first().triangles

    def apply(self, batch: Batch) -> None:
        inserted, deleted = effective_changes(self.graph, self.graph.frame(batch))
        gone = similarity.triangle_delta(self.graph.arcs(), deleted)
        self.graph.apply(batch)
        self.value += similarity.triangle_delta(self.graph.arcs(), inserted) - gone


class IncrementalKCore:
    """Core numbers; the components of all endpoints, before and after the batch, are peeled again."""

    def __init__(self, graph: Graph):
        schema.undirected_only(graph.directed, "the k-core")
        self.graph, self.last_repaired_vertices = graph, 0
        self.recompute()

    def recompute(self) -> None:
        self.cores = fixpoint.cut(kcore.core_numbers(self.graph.arcs(), self.graph.vertices()))

    def apply(self, batch: Batch) -> None:
        updates = self.graph.frame(batch).where("src <> dst")
        ends = fixpoint.cut(updates.select(F.explode(F.array("src", "dst")).alias("v")).distinct())
        self.graph.apply(batch)
        arcs = fixpoint.cut(self.graph.arcs())
        # All edges that differ have their ends among ``ends``, so what can be reached from there is the same before and after.
        region = traversal.bfs(arcs, ends).select("v")
        self.last_repaired_vertices = region.count()
        # Where no vertex gets more than k edges, no core number rises by more than k: what is left of a core without them is a core k lower.
        added = updates.where("add").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        gain = degrees(schema.symmetric(added)).agg(F.coalesce(F.max("degree"), F.lit(0))).first()[0]
        most = self.cores.select("v", (F.col("core") + gain).alias("most"))
        new = kcore.core_numbers(arcs.join(region.withColumnRenamed("v", "src"), "src", "left_semi"), region, most)
        rest = self.graph.vertices().join(region, "v", "left_anti").join(self.cores, "v", "left").select("v", F.coalesce("core", F.lit(0)).cast("long").alias("core"))
        self.cores = fixpoint.cut(rest.unionByName(new))


@dataclass(frozen=True)
class PageRankValidation:
    l1_error: float
    linf_error: float
    residual_l1: float
    residual_linf: float
    reference_converged: bool
    within_tolerance: bool


class IncrementalPageRank:
    """Ranks, repaired around a batch while that stays local; validated against a full solve within a tolerance."""

    def __init__(self, graph: Graph, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-12):
        self.graph, self.damping, self.rounds, self.tolerance = graph, damping, rounds, tolerance
        self.last_used_full_recompute, self.last_active_vertices, self.last_iterations, self._solved = True, 0, 0, None
        self.recompute()

    def recompute(self) -> None:
        got = pagerank.solve(self.graph.arcs(), self.graph.n, self.damping, self.rounds, self.tolerance, "linf", keep=True)
        self._release(got)
        self.ranks, self.last_iterations, self.last_l1, self.last_linf, self.converged = got.ranks, got.iterations, got.l1, got.linf, got.converged

    def _release(self, solved: pagerank.Solve | None = None) -> None:
        """Drop the cached blocks of the last full solve, for those of another or none."""
        if self._solved is not None and self._solved.state is not None:
            self._solved.state.close()
        self._solved, self._solved_version = solved, self.graph.version

    def apply(self, batch: Batch, rounds: int = 24, tolerance: float = 1e-9, most_active: float = 0.60) -> None:
        """Full if the vertex count changes, any vertex dangled before or a touched one does after, or too many become active."""
        updates, before = self.graph.frame(batch), self.graph.n
        dangling = before == 0 or pagerank.dangling_count(self.graph.arcs(), before) > 0
        inserted, deleted = effective_changes(self.graph, updates)
        self.graph.apply(batch)
        self._release()
        arcs, n = fixpoint.cut(self.graph.arcs()), self.graph.n
        ends = updates.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        self.last_used_full_recompute, self.last_active_vertices = True, 0
        if dangling or n != before or not ends.join(arcs.select(F.col("src").alias("v")), "v", "left_anti").isEmpty():
            return self.recompute()
        # Rows whose sum changes: the heads of changed arcs, and all heads of tails whose degree changed.
        changed = inserted.unionByName(deleted)
        tails = changed.select("src").distinct()
        active = fixpoint.cut(changed.select(F.col("dst").alias("v")).unionByName(arcs.join(tails, "src", "left_semi").select(F.col("dst").alias("v"))).distinct())
        ever, limit, ranks, shares = active, max(1, int(n * most_active)), self.ranks, None
        for k in range(1, rounds + 1):
            size = active.count()
            self.last_active_vertices = ever.count()
            if not size:
                break
            if size >= limit or self.last_active_vertices >= limit:
                return self.recompute()
            shares = pagerank.spread(arcs) if shares is None else shares
            into = shares.join(fixpoint.sized(active.withColumnRenamed("v", "dst"), size), "dst", "left_semi").join(ranks.toDF("src", "rank"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") * F.col("w")).alias("_in"))
            new = active.join(into, "v", "left").select("v", (F.lit((1 - self.damping) / n) + self.damping * F.coalesce("_in", F.lit(0.0))).alias("_new"))
            joined = fixpoint.cut(ranks.join(new, "v", "left").select("v", F.coalesce("_new", "rank").alias("rank"), F.abs(F.coalesce("_new", "rank") - F.col("rank")).alias("_by")))
            moved = joined.where(F.col("_by") > tolerance).select(F.col("v").alias("src"))
            active = fixpoint.cut(arcs.join(moved, "src", "left_semi").select(F.col("dst").alias("v")).distinct())
            ever, ranks, self.last_iterations = fixpoint.cut(ever.unionByName(active).distinct()), joined.select("v", "rank"), k
        self.ranks, self.last_used_full_recompute = fixpoint.cut(ranks), False

    def validate_against_full(self, rounds: int = 500, tolerance: float = 1e-12, most_l1: float = 1e-6, most_linf: float = 1e-7) -> PageRankValidation:
        arcs, n = self.graph.arcs(), self.graph.n
        # A full solve of this version that didn't go as far is gone on with, else begun from uniform ranks.
        solved, self._solved = self._solved, None
        same = solved is not None and solved.state is not None and self._solved_version == self.graph.version and solved.iterations <= rounds and not solved.linf < tolerance
        if solved is not None and solved.state is not None and not same:
            solved.state.close()
        self._reference = pagerank.solve(arcs, n, self.damping, rounds, tolerance, "linf", keep=True, after=solved if same else None)
        l1, linf = pagerank.difference(self.ranks, self._reference.ranks)
        r1 = rinf = 0.0
        if self._reference.state is not None:
            r1, rinf = pagerank.residual(self.ranks, self._reference.state)
            self._reference.state.close()
        return PageRankValidation(l1, linf, r1, rinf, self._reference.converged, l1 <= most_l1 and linf <= most_linf)

    def apply_validated(self, batch: Batch, rounds: int = 64, tolerance: float = 1e-10, most_active: float = 0.95, **limits) -> PageRankValidation:
        """Apply, validate, and install the full solution where validation fails."""
        self.apply(batch, rounds, tolerance, most_active)
        found = self.validate_against_full(**limits)
        if not found.within_tolerance:
            self.ranks, self.last_used_full_recompute = fixpoint.cut(self._reference.ranks), True
        return found
