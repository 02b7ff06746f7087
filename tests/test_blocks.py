"""Rounds over blocks: the same results as plain ones, in few rounds."""

import random

import pytest

from evograph import schema
from evograph.operators import graph as gr
from evograph.operators import kcore, maintained, pagerank, similarity, traversal
from evograph.plans import blocks, fixpoint


@pytest.fixture
def cuts(monkeypatch):
    """Counts checkpoints."""
    real, made = fixpoint.cut, []
    monkeypatch.setattr(fixpoint, "cut", lambda df: made.append(1) or real(df))
    return made


def arcs_of(spark, edges):
    return schema.symmetric(spark.createDataFrame(sorted(edges), "src long, dst long"))


def naive_cores(edges, ids):
    near = {v: set() for v in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda u: len(near[u]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


def crossing(seed, n=90, m=260):
    """Edges among ids that lie in three blocks and one far away."""
    draw = random.Random(seed)
    ids = [(v % 3) * blocks.SIZE + v for v in range(n)] + [2**32 - 5]
    edges = {tuple(sorted(draw.sample(ids, 2))) for _ in range(m)} | {(ids[0], ids[-1])}
    return ids, edges


def test_cores_across_blocks(spark):
    ids, edges = crossing(3)
    everyone = spark.createDataFrame([(v,) for v in ids + [7 * blocks.SIZE]], "v long")
    want = naive_cores(edges, ids + [7 * blocks.SIZE])
    assert dict(kcore.core_numbers(arcs_of(spark, edges), everyone).collect()) == want
    most = spark.createDataFrame([(v, c + 1) for v, c in want.items()], "v long, most long")
    assert dict(kcore.core_numbers(arcs_of(spark, edges), everyone, most).collect()) == want


def test_a_long_path_is_peeled_in_few_rounds(spark, cuts):
    path = {(v, v + 1) for v in range(60)}
    assert set(dict(kcore.core_numbers(arcs_of(spark, path), schema.vertices(spark, 61)).collect()).values()) == {1}
    assert len(cuts) < 10


def test_maintained_cores_search_once_a_batch(spark, monkeypatch):
    real, searches = traversal.bfs, []
    monkeypatch.setattr(traversal, "bfs", lambda *a: searches.append(1) or real(*a))
    g = gr.Graph(spark, 41, False)
    edges = {(v, (v + 1) % 40) for v in range(40)}
    g.apply(gr.UpdateBatch([(a, b, True, 0) for a, b in sorted(edges)]))
    kept = maintained.IncrementalKCore(g)
    assert dict(kept.cores.collect()) == {v: 2 * (v < 40) for v in range(41)}
    kept.apply(gr.UpdateBatch([(3, 4, False, 0), (40, 1, True, 0)]))
    assert dict(kept.cores.collect()) == dict.fromkeys(range(41), 1)
    kept.apply(gr.UpdateBatch([(a, b, True, 0) for a in range(4) for b in range(a)]))
    assert dict(kept.cores.collect()) == naive_cores(edges - {(3, 4)} | {(1, 40)} | {(b, a) for a in range(4) for b in range(a)}, range(41))
    assert len(searches) == 2


def test_ranks_across_blocks_and_a_solve_that_goes_on(spark):
    draw = random.Random(5)
    n = blocks.SIZE + 60
    ids = list(range(blocks.SIZE - 40, n))
    edges = {(a, b) for a, b in ((draw.choice(ids), draw.choice(ids)) for _ in range(300)) if a != b}
    arcs = spark.createDataFrame(sorted(edges), "src long, dst long")
    rank, heads = [1 / n] * n, {}
    for a, b in edges:
        heads.setdefault(a, []).append(b)
    for _ in range(6):
        new = [0.15 / n + 0.85 * sum(r for v, r in enumerate(rank) if v not in heads) / n] * n
        for a, out in heads.items():
            for b in out:
                new[b] += 0.85 * rank[a] / len(out)
        rank = new
    got = dict(pagerank.fixed_rounds(arcs, n, 6).collect())
    assert len(got) == n and max(abs(got[v] - rank[v]) for v in range(n)) < 1e-14
    first = pagerank.solve(arcs, n, rounds=2, tolerance=0.0, keep=True)
    more = pagerank.solve(arcs, n, rounds=6, tolerance=0.0, after=first)
    assert more.iterations == 6 and max(abs(r - rank[v]) for v, r in more.ranks.collect()) < 1e-14


def test_adjacent_pairs_are_counted_from_triangles(spark):
    ids, edges = crossing(8, 30, 150)
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in ids}
    arcs = arcs_of(spark, edges)
    got = {(r.a, r.b): r.common for r in similarity.adjacent_common(arcs).collect()}
    assert got == {(a, b): len(near[a] & near[b]) for a, b in edges}
    assert similarity.triangle_count(arcs).first()[0] * 3 == sum(got.values())


def test_distances_across_wide_blocks_and_along_a_path(spark, cuts):
    wide, n = 1 << blocks.WIDE, 40
    weight = {(v, v + 1): 3 for v in range(n)} | {(5, wide + 1): 0, (wide + 1, 30): 1, (30, 2): 1, (7, 2**32 - 9): schema.INFINITY - 1}
    arcs = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, w long")
    want, changed = {0: 0}, True
    while changed:
        changed = False
        for (a, b), w in weight.items():
            if a in want and want[a] + w < min(want.get(b, schema.INFINITY), schema.INFINITY):
                want[b], changed = want[a] + w, True
    assert dict(traversal.shortest_paths(arcs, 0).collect()) == want
    assert len(cuts) < 12
