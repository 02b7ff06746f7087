import heapq
import random

import pytest

from evograph import schema
from evograph.operators import components, kcore, maintained, pagerank, similarity, traversal
from evograph.operators.graph import Graph, UpdateBatch
from evograph.operators.weighted import WeightedGraph, WeightedUpdateBatch


def naive_bfs(edges, source):
    dist, queue = {source: 0}, [source]
    for u in queue:
        for a, b in sorted(edges):
            if a == u and b not in dist:
                dist[b] = dist[u] + 1
                queue.append(b)
    return dist


def naive_dijkstra(weights, source):
    dist, heap = {}, [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for (a, b), w in weights.items():
            if a == u:
                heapq.heappush(heap, (d + w, b))
    return dist


def naive_labels(edges, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def naive_cores(edges, n):
    core, left, k = [0] * n, set(range(n)), 0
    while left:
        deg = {v: sum(a == v and b in left for a, b in edges) for v in left}
        v = min(left, key=lambda x: (deg[x], x))
        k = max(k, deg[v])
        core[v] = k
        left.remove(v)
    return core


def naive_triangles(edges):
    return sum((a, b) in edges and (b, c) in edges and (a, c) in edges for a, b in edges if a < b for c in {y for x, y in edges if x == b} if b < c)


def naive_rank(edges, n, rounds=300):
    out = [sum(a == v for a, _ in edges) for v in range(n)]
    rank = [1 / n] * n
    for _ in range(rounds):
        lost = sum(rank[v] for v in range(n) if not out[v])
        new = [(0.15 + 0.85 * lost) / n] * n
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    return rank


def column(df, name):
    return [r[name] for r in df.orderBy("v").collect()]


def make(spark, rng, n, m, directed=False):
    g = Graph(spark, n, directed)
    batch = UpdateBatch()
    for _ in range(m):
        batch.add(rng.randrange(n), rng.randrange(n))
    g.apply(batch)
    return g, {(r.src, r.dst) for r in g.arcs().collect()}


def change(rng, edges, n, size, directed=False):
    batch = UpdateBatch()
    for _ in range(size):
        u, v = rng.choice(sorted(edges)) if edges and rng.random() < 0.5 else (rng.randrange(n), rng.randrange(n))
        add = rng.random() < 0.5
        (batch.add if add else batch.remove)(u, v)
        if u != v:
            for e in {(u, v)} if directed else {(u, v), (v, u)}:
                (edges.add if add else edges.discard)(e)
    return batch


def test_static_answers(spark):
    rng = random.Random(1)
    n = 24
    g, edges = make(spark, rng, n, 26)
    arcs, everyone = g.arcs().persist(), g.vertices()
    want = naive_bfs(edges, 0)
    assert column(traversal.bfs_distances(arcs, n, 0), "d") == [want.get(v, schema.UNREACHABLE) for v in range(n)]
    assert column(traversal.sssp_distances(arcs, n, 0, False), "d") == [want.get(v, schema.INFINITY) for v in range(n)]
    labels = naive_labels(edges, n)
    assert column(components.min_labels(arcs, everyone), "component") == labels
    roots = sorted(set(labels))
    assert column(components.connected_components(arcs, everyone), "component") == [roots.index(x) for x in labels]
    assert column(kcore.core_numbers(arcs, everyone), "core") == naive_cores(edges, n)
    assert similarity.triangle_count(arcs).first().triangles == naive_triangles(edges)
    got = pagerank.solve(arcs, n, rounds=5, tolerance=0.0)
    assert not got.converged and max(abs(a - b) for a, b in zip(column(got.ranks, "rank"), naive_rank(edges, n, 5))) < 1e-12
    with pytest.raises(IndexError):
        traversal.bfs_distances(arcs, n, n)
    with pytest.raises(ValueError):
        pagerank.solve(arcs, n, damping=1.5)


def test_similarity_of_a_toy(spark):
    arcs = schema.simple_arcs(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long"), False)
    row = similarity.jaccard(arcs, spark.createDataFrame([(0, 1), (7, 8)], "a long, b long")).orderBy("a").collect()
    assert row[0].common == 1 and row[0].jaccard == pytest.approx(1 / 3) and row[1].jaccard == 0.0


def test_long_path_components(spark):
    arcs = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert set(column(components.min_labels(arcs, schema.vertices(spark, 301)), "component")) == {0}


def test_maintained_bfs(spark):
    rng = random.Random(3)
    n = 20
    g, edges = make(spark, rng, n, 40, True)
    kept = maintained.IncrementalBFS(g, 0, 2.0)
    for _ in range(1):
        kept.apply(change(rng, edges, n, 6, True))
        want = naive_bfs(edges, 0)
        assert column(kept.distances, "d") == [want.get(v, schema.UNREACHABLE) for v in range(n)]
        assert not kept.last_used_full_recompute


def test_alternate_parent_and_cascade(spark):
    g = Graph(spark, 6, True)
    g.apply(UpdateBatch().add(0, 1).add(0, 2).add(1, 3).add(2, 3).add(3, 4))
    kept = maintained.IncrementalBFS(g, 0)
    kept.apply(UpdateBatch().remove(1, 3))
    assert (kept.last_affected_vertices, kept.last_deletion_candidates) == (0, 1)
    kept.fallback = 0.1
    kept.apply(UpdateBatch().remove(2, 3))
    assert kept.last_used_full_recompute and column(kept.distances, "d")[3:5] == [schema.UNREACHABLE] * 2
    out = maintained.IncrementalBFS(g, 40)
    assert out.reachable_count == 0


def test_maintained_undirected(spark):
    rng = random.Random(5)
    n = 16
    g, edges = make(spark, rng, n, 18)
    others = [Graph.from_edges(g.arcs(), False, n) for _ in range(2)]
    cc, tri, core = maintained.IncrementalComponents(g), maintained.IncrementalTriangleCount(others[0]), maintained.IncrementalKCore(others[1])
    for _ in range(1):
        batch = change(rng, edges, n, 7)
        for kept in (cc, tri, core):
            kept.apply(batch)
        assert column(cc.labels, "component") == naive_labels(edges, n)
        assert tri.value == naive_triangles(edges)
        assert column(core.cores, "core") == naive_cores(edges, n)


def test_region_sizes(spark):
    g = Graph(spark, 8, False)
    g.apply(UpdateBatch().add(0, 1).add(1, 2).add(2, 3).add(4, 5).add(5, 6))
    cc = maintained.IncrementalComponents(g)
    cc.apply(UpdateBatch().remove(1, 2))
    assert cc.last_repaired_vertices == 4 and column(cc.labels, "component") == [0, 0, 2, 2, 4, 4, 4, 7]
    h = Graph(spark, 6, False)
    h.apply(UpdateBatch().add(0, 1).add(1, 2).add(2, 0).add(3, 4).add(4, 5).add(5, 3))
    core = maintained.IncrementalKCore(h)
    core.apply(UpdateBatch().remove(0, 1))
    assert core.last_repaired_vertices == 3
    core.apply(UpdateBatch().add(2, 3))
    assert core.last_repaired_vertices == 6
    for kind in (maintained.IncrementalComponents, maintained.IncrementalKCore, maintained.IncrementalTriangleCount):
        with pytest.raises(ValueError):
            kind(Graph(spark, 2, True))


def test_maintained_paths(spark):
    g = Graph(spark, 5, True)
    g.apply(UpdateBatch().add(0, 1).add(1, 2).add(2, 3))
    kept = maintained.IncrementalSSSP(g, 0)
    kept.apply(UpdateBatch().add(0, 3))
    assert not kept.last_used_full_recompute and column(kept.distances, "d") == [0, 1, 2, 1, schema.INFINITY]
    kept.apply(UpdateBatch().remove(4, 0))
    assert kept.last_used_full_recompute
    w = WeightedGraph(spark, 4, False)
    w.apply(WeightedUpdateBatch().add(0, 1, 5).add(1, 2, 1).add(0, 2, 9).add(2, 3, 0))
    weighted = maintained.IncrementalWeightedSSSP(w, 0)
    assert column(weighted.distances, "d") == [0, 5, 6, 6]
    weighted.apply(WeightedUpdateBatch().update(0, 2, 3))
    assert not weighted.last_used_full_recompute and column(weighted.distances, "d") == [0, 4, 3, 3]
    weighted.apply(WeightedUpdateBatch().update(2, 3, 7).remove(0, 1))
    weights = {(r.src, r.dst): r.w for r in w.weighted_arcs().collect()}
    want = naive_dijkstra(weights, 0)
    assert weighted.last_used_full_recompute and column(weighted.distances, "d") == [want[v] for v in range(4)]


def test_maintained_ranks(spark):
    g = Graph(spark, 8, True)
    batch = UpdateBatch()
    for base in (0, 4):
        for k in range(4):
            batch.add(base + k, base + (k + 1) % 4)
    g.apply(batch)
    kept = maintained.IncrementalPageRank(g)
    assert kept.last_iterations == 1 and kept.converged
    kept.apply(UpdateBatch().add(0, 2), rounds=8, tolerance=1e-3, most_active=0.95)
    assert not kept.last_used_full_recompute and kept.last_active_vertices <= 4
    found = kept.validate_against_full(rounds=8, tolerance=1e-3, most_l1=0.05, most_linf=0.02)
    assert found.within_tolerance and found.residual_linf < 0.02
    kept.rounds = 4
    kept.apply(UpdateBatch().remove(3, 0))
    assert kept.last_used_full_recompute
    edges = {(r.src, r.dst) for r in g.arcs().collect()}
    assert max(abs(a - b) for a, b in zip(column(kept.ranks, "rank"), naive_rank(edges, 8, 4))) < 1e-9
