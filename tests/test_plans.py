import numpy as np
import pytest

from evograph.functions import codec
from evograph.operators import reports, streams
from evograph.plans import consolidation, planner
from evograph.sources import files, memory, text


def test_analytic_chooser():
    small = planner.choose(planner.Estimate(10, 1000, 5, 100, speedup=4))
    large = planner.choose(planner.Estimate(900, 1000, 90, 100, 3.0, 1.0, 1.0, 0.4))
    assert small.incremental and not large.incremental and planner.choose(planner.Estimate()).full_cost == 0
    assert small.explain().startswith("mode=incremental; incremental_cost=")


def run(preset, n, rows, reach=1.0):
    return [r["reason"] for r in planner.replay(preset, rows, n, 100.0, reach)]


def test_selectors():
    cheap = {"update_fraction": 0.001, "incremental_us": 10.0, "full_us": 100.0}
    dear = cheap | {"incremental_us": 1000.0}
    assert run("adaptive", 1000, [cheap | {"update_fraction": 0.05}]) == ["scale_preflight_full"]
    assert run("adaptive", 1000, [cheap], 0.02) == ["scale_very_sparse_reach"]
    assert run("adaptive", 1000, [cheap | {"update_fraction": 0.0025}], 0.1) == ["scale_sparse_reach_guard"]
    assert run("adaptive", 1000, [dear, dear]) == ["scale_insufficient_evidence_incremental", "scale_fresh_cost_model"]
    assert run("adaptive", 200_000, [dear | {"shallow_deletions": 0.1}]) == ["large_shallow_cold_start"]
    assert run("adaptive", 200_000, [dear, dear, dear])[:2] == ["large_initial_incremental_probe", "large_uncertainty_confident_full"]
    assert run("adaptive_v2", 1000, [cheap, cheap]) == ["incremental_probe", "uncertain_or_incremental"]
    assert "tail_confirmation_probe" in run("adaptive_v3", 1000, [cheap, cheap, dear | {"incremental_us": 90.0}, cheap])
    assert run("history_cost_model", 1000, [cheap] * 6)[:5] == ["history_calibrate_incremental"] * 3 + ["history_calibrate_full"] * 2
    tie = planner.replay("always_incremental", [cheap | {"incremental_us": 100.0}], 10, 1.0)[0]
    assert tie["oracle_full"] and tie["regret"] == 0


def test_consolidation_controller():
    c = consolidation.Controller()
    breach = consolidation.Signal(1.15, 1.4, False, True)
    assert [c.observe(breach, k) for k in range(1, 6)] == [False] * 4 + [True]
    c.mark(5)
    assert not any(c.observe(breach, k) for k in range(6, 15)) and c.streak == 0
    assert [c.observe(breach, k) for k in range(15, 20)] == [False] * 4 + [True]
    assert c.observe(consolidation.Signal(1.3, 1.0, True, False), 7)
    assert not consolidation.Controller(breaches=1).observe(consolidation.Signal(1.05, 1.4, False, True), 1)
    assert consolidation.evaluate(10, 0, 1, 0).storage_ratio == 1.0
    assert consolidation.scale_aware(100_000_000).storage == 1.5 and consolidation.scale_aware(99_999_999).storage == 1.25


def test_codecs():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [5, 5, 7], np.unique(rng.integers(0, 1 << 32, 700)), list(range(300))):
        ids = np.asarray(ids, np.int64)
        assert codec.undeltas(codec.varbyte_decode(codec.varbyte_encode(codec.deltas(ids)))).tolist() == ids.tolist()
        assert codec.blocked_varbyte_decode(*codec.blocked_varbyte(ids)).tolist() == ids.tolist()
        assert codec.fixed_decode(*codec.fixed_encode(ids)).tolist() == ids.tolist()
    assert codec.varbyte_encode([300]) == b"\xac\x02" and codec.ratio(0, 0) == 1.0 and codec.ratio(2, 0) == 0.0
    for bad in (lambda: codec.deltas([2, 1]), lambda: codec.varbyte_decode(b"\x80"), lambda: codec.varbyte_decode(b"\xff\xff\xff\xff\xff\x01"), lambda: codec.fixed_encode([1], 0), lambda: codec.choice(None, overhead=0.9)):
        with pytest.raises(ValueError):
            bad()


def test_edge_lists(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text("# c\n% c\n\n  0 1\n1\t2\n")
    g = text.load_edge_list(spark, str(path))
    assert g.n == 3 and g.edge_entry_count() == 4
    for line, why in (("3", "missing column"), ("3 x", "not a number"), ("3 4 5", "trailing data"), ("3 4294967296", "overflow"), ("-1 2", "overflow")):
        path.write_text(f"0 1\n{line}\n")
        with pytest.raises(Exception, match=f"{why} at line 2"):
            text.read_strict(spark, str(path)).collect()
    path.write_text("#x\n1 1\nfoo\n2 3 9\n2 3\n")
    assert [tuple(r)[1:] for r in text.read_lenient(spark, str(path)).orderBy("pos").collect()] == [(1, 1), (2, 3), (2, 3)]
    assert [tuple(r)[1:] for r in text.read_weighted(spark, str(path)).collect()] == [(2, 3, 9)]


def test_memory_and_files(spark, tmp_path):
    g = memory.from_numpy_edges(spark, np.array([[0, 1], [1, 2]]))
    files.save_binary(g, str(tmp_path / "g.bin"))
    assert files.load_binary(spark, str(tmp_path / "g.bin")).digest() == g.digest()
    files.save_graph(g, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g")).digest() == g.digest()
    (tmp_path / "bad").write_bytes((tmp_path / "g.bin").read_bytes()[:-1])
    with pytest.raises(ValueError):
        files.load_binary(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        memory.from_numpy_edges(spark, np.array([1, 2]))

    class Csr:
        shape, indptr, indices = (4, 4), [0, 1, 2, 2, 2], [1, 0]

    assert memory.from_scipy_csr(spark, Csr()).n == 4
    files.write_partition(str(tmp_path / "p"), 7, b"abcdef")
    assert files.read_partition(str(tmp_path / "p"), 7) == b"abcdef"
    with pytest.raises(ValueError):
        files.read_partition(str(tmp_path / "p"), 8)
    (tmp_path / "d").write_text("x")
    with pytest.raises(ValueError):
        files.prepare_dataset(str(tmp_path / "d"), str(tmp_path / "t"), "00")
    assert not (tmp_path / "t").exists()


def test_streams(spark):
    s = spark.createDataFrame([(0, 5, 9), (1, 9, 5), (2, 9, 9), (3, 5, 20)], "pos long, src long, dst long")
    assert {tuple(r) for r in streams.normalize(s.select("src", "dst")).collect()} == {(0, 1), (0, 2)}
    assert tuple(streams.normalize_counts(s.select("src", "dst")).first()) == (4, 3, 1, 1, 2)
    with pytest.raises(ValueError):
        streams.pinned(s)
    with pytest.raises(ValueError):
        streams.symmetric_stream(s)
    pair = streams.symmetric_stream(s.where("pos < 2")).orderBy("k").collect()
    assert [(r.src, r.dst) for r in pair] == [(5, 9), (9, 5)]
    batches = streams.window_batches(s, 2, 1).orderBy("batch", "seq").collect()
    assert [(r.batch, r.src, r["add"]) for r in batches] == [(0, 9, True), (0, 5, False), (1, 5, True), (1, 9, False)]
    assert len(streams.missing_edges(6, {(0, 1)}, 5)) == 5


def test_report(spark):
    rows = spark.createDataFrame([("d", 1, "p", 2.0, 1.0, True, False, False), ("d", 1, "p", 1.0, 1.0, False, False, True)], "dataset string, batch_size int, policy string, batch_us double, oracle_batch_us double, explicit_full boolean, oracle_full boolean, internal_fallback boolean")
    r = reports.regret_summary(rows).first()
    assert (r.mean_regret, r.max_regret, r.wrong_arm_rate, r.internal_fallback_fraction) == (0.5, 1.0, 0.5, 0.5)


def test_split_is_exact_and_no_task_gathers_its_rows(spark):
    import hashlib

    rows = [(p, p * 7 % 50, 100 + p * 3) for p in range(500)]
    first, rest = streams.seeded_split(spark.createDataFrame(rows, "pos long, src long, dst long"), 11, 0.9)
    order = sorted(rows, key=lambda r: hashlib.sha256("11:{}:{}:{}".format(*r).encode()).hexdigest())
    assert {tuple(r) for r in first.collect()} == set(order[:450]) and {tuple(r) for r in rest.collect()} == set(order[450:])
    assert not any("SinglePartition" in df._jdf.queryExecution().toString() for df in (first, rest))
    for share, n in ((0.0, 0), (1.0, 500)):
        first, rest = streams.seeded_split(spark.createDataFrame(rows, "pos long, src long, dst long"), 11, share)
        assert (first.count(), rest.count()) == (n, 500 - n)
