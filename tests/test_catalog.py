from collections import defaultdict

from evograph import catalog

SF = "/root/testdata/sf0.001"


def neighbours(spark):
    out = defaultdict(set)
    for r in catalog.customer_arcs(spark, SF).collect():
        out[r.src].add(r.dst)
    return out


def test_every_order_probes_and_every_adjacent_pair_is_compared(spark):
    found, near, n = catalog.queries(), neighbours(spark), catalog.customers(spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    probes = {(r.o_custkey, r.o_orderkey % n) for r in orders}
    assert sorted(map(tuple, found["has_edge_whole"](spark, SF).collect())) == sorted((a, b, b in near[a]) for a, b in probes)
    pairs = {(a, b): len(near[a] & near[b]) for a in list(near) for b in near[a] if a < b}
    assert {(r.a, r.b): r.common for r in found["common_neighbors_whole"](spark, SF).collect()} == pairs
    assert {(r.a, r.b): r["size"] for r in found["kernel_choice_whole"](spark, SF).collect()} == pairs
    for r in found["jaccard_whole"](spark, SF).collect():
        assert r.common == pairs.pop((r.a, r.b)) and abs(r.jaccard - r.common / len(near[r.a] | near[r.b])) < 1e-12
    assert not pairs


def test_components_and_reach_of_the_whole_customer_graph(spark):
    found, near, n = catalog.queries(), neighbours(spark), catalog.customers(spark, SF)
    label = {}
    for v in range(n):
        if v not in label:
            label[v], todo = v, [v]
            while todo:
                for w in near[todo.pop()]:
                    if w not in label:
                        label[w] = v
                        todo.append(w)
    names = {c: k for k, c in enumerate(sorted(set(label.values())))}
    assert dict(found["components_whole"](spark, SF).collect()) == {v: names[c] for v, c in label.items()}
    sizes = {r.component: r.n for r in found["component_sizes_whole"](spark, SF).collect()}
    assert sizes == {c: list(label.values()).count(c) for c in names}
    start = min(v for v in near if near[v])
    assert found["reachable_whole"](spark, SF).first().reached == sizes[label[start]]
    assert found["dangling_count_whole"](spark, SF).first()[0] == sum(not near[v] for v in range(n))
