import random

import pytest
from pyspark.sql import functions as F

from evograph.operators import graph as gr
from evograph.operators.graph import Graph, UpdateBatch
from evograph.operators.temporal import TemporalGraph
from evograph.operators.weighted import WeightedGraph, WeightedUpdateBatch
from evograph.schema import INFINITY


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_simple_graph_contract(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0), (2, 3), (9, 9)], "src long, dst long"))
    assert g.n == 4 and g.edge_entry_count() == 8 and g.degree(2) == 3 and g.neighbors(2) == [0, 1, 3]
    assert g.neighbors(50) == [] and g.has_edge(3, 2) and not g.has_edge(0, 3)
    with pytest.raises(IndexError):
        g.checked_neighbors(4)


def test_last_operation_wins_and_versions(spark):
    g = Graph(spark, 3, False)
    g.apply(UpdateBatch().add(0, 1).remove(1, 0).add(1, 2))
    assert pairs(g.arcs()) == {(1, 2), (2, 1)} and g.version == 1
    g.apply(UpdateBatch())
    assert g.version == 1
    g.apply(UpdateBatch().add(70, 70))
    assert g.version == 2 and g.n == 3
    g.remove_edge(8, 9)
    assert g.n == 10 and pairs(g.arcs()) == {(1, 2), (2, 1)}
    g.ensure_vertex(20)
    assert g.n == 21


def test_overlay_cancels_and_compacts(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), True)
    g.apply(UpdateBatch().remove(0, 1).add(0, 1).add(2, 0))
    assert g.delta_edge_count() == 1 and g.dirty_rows() == 1
    g.apply(UpdateBatch().remove(2, 0))
    assert g.delta_edge_count() == 0
    g.apply(UpdateBatch().add(2, 0).add(2, 1).remove(1, 2))
    before = g.digest()
    assert g.maybe_compact(0.25) == 1 and g.delta_edge_count() == 1 and g.digest() == before
    fresh = g.consolidated()
    assert fresh.digest() == before and fresh.delta_edge_count() == 0 and g.delta_edge_count() == 1
    g.compact()
    assert g.digest() == before and g.in_neighbors(1) == [0, 2]


@pytest.mark.parametrize("directed", [True, False])
def test_random_batches(spark, directed):
    rng, g, edges = random.Random(4), Graph(spark, 0, directed), set()
    for _ in range(4):
        batch = UpdateBatch()
        for _ in range(25):
            u, v = rng.randrange(9), rng.randrange(9)
            (batch.add if rng.random() < 0.6 else batch.remove)(u, v)
        for u, v, add, _ in batch.rows:
            for e in {(u, v)} if directed else {(u, v), (v, u)}:
                if u != v:
                    (edges.add if add else edges.discard)(e)
        g.apply(batch)
        assert pairs(g.arcs()) == edges


def test_weights(spark):
    g = WeightedGraph(spark, 4, False)
    g.apply(WeightedUpdateBatch().add(0, 1, 5).update(1, 0, 2).add(1, 2, 0))
    assert g.weight(0, 1) == 2 and g.weight(2, 1) == 0 and g.weight(0, 3) is None and g.degree(1) == 2
    with pytest.raises(ValueError):
        g.apply(WeightedUpdateBatch().add(2, 3, 1).add(0, 1, INFINITY))
    assert g.weight(2, 3) is None and g.version == 1
    g.apply(WeightedUpdateBatch().remove(0, 1).add(5, 6, INFINITY - 1))
    assert g.neighbors(1) == [(2, 0)] and g.n == 7


def test_time_travel(spark):
    t = TemporalGraph(spark, 4, True)
    t.apply(UpdateBatch().add(0, 1, 10).add(1, 2, 20))
    t.apply(UpdateBatch().remove(0, 1, 30).add(2, 3, 40))
    assert pairs(t.snapshot_version(1)) == {(0, 1), (1, 2)} and pairs(t.snapshot_version(2)) == {(1, 2), (2, 3)}
    assert pairs(t.snapshot_time(20)) == {(0, 1), (1, 2)} and pairs(t.snapshot_time(30)) == {(1, 2)}
    assert t.changes_between_versions(1, 2).count() == 2 and t.changes_between_times(10, 30).count() == 2
    assert pairs(t.sliding_window(40, 10)) == {(2, 3)} and pairs(t.sliding_window(30, 25)) == {(1, 2)}
    assert [tuple(r) for r in t.history().orderBy("version").collect()] == [(1, 10, 20, 2), (2, 30, 40, 2)]
    for bad in (lambda: t.snapshot_version(3), lambda: t.changes_between_versions(2, 1), lambda: t.changes_between_times(5, 1)):
        with pytest.raises(ValueError):
            bad()


def test_arrival_order_beats_time_stamps(spark):
    t = TemporalGraph(spark, 0, True)
    t.apply(UpdateBatch().add(0, 1, 50))
    t.apply(UpdateBatch().remove(0, 1, 5))
    assert pairs(t.snapshot_time(60)) == set()
    t.apply(UpdateBatch().add(4, 5))
    assert pairs(t.snapshot_time(0)) == {(4, 5)} and pairs(t.sliding_window(100, 1000)) == set()


def test_compaction_rows(spark):
    base = spark.createDataFrame([(0, k) for k in range(1, 11)], "src long, dst long")
    over = spark.createDataFrame([(0, 20, True), (0, 1, False), (0, 2, False), (3, 4, True), (3, 5, True)], "src long, dst long, add boolean")
    rows = {r.src: r.density for r in gr.compaction_candidates(base, over).collect()}
    assert rows == {0: 0.3, 3: 0.25}
    assert gr.compaction_candidates(base, over, 0.26).select(F.max("src")).first()[0] == 0
