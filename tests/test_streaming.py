from evograph import schema
from evograph.operators import maintained
from evograph.operators.graph import Graph, UpdateBatch
from evograph.streaming.maintain import LogStore, StreamingMaintainer, read_updates


def test_micro_batches_are_versions(spark, tmp_path):
    batches = [UpdateBatch().add(0, 1).add(1, 2), UpdateBatch().remove(1, 2).add(2, 3)]
    for k, b in enumerate(batches):
        b.frame(spark, k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    g = Graph(spark, 4, False)
    kept = maintained.IncrementalTriangleCount(g, 0)
    runner = StreamingMaintainer([kept], lambda: g.arcs(), f"{tmp_path}/out")
    runner.start(read_updates(spark, f"{tmp_path}/in", 1), f"{tmp_path}/cp").awaitTermination(100)
    assert g.version == 2 and runner.done == 1
    assert {(r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    runner.process(batches[1].frame(spark), 1)
    assert g.version == 2


def test_log_store_replaces_a_retried_batch(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.append(schema.updates_frame(spark, [(0, 0, 0, 1, True, 0)]), 1)
    store.append(schema.updates_frame(spark, [(0, 0, 5, 6, True, 0)]), 2)
    store.append(schema.updates_frame(spark, [(0, 0, 1, 2, True, 0)]), 2)
    assert {(r.src, r.dst) for r in store.snapshot(2, True).collect()} == {(0, 1), (1, 2)}
    assert {(r.src, r.dst) for r in store.snapshot(1, True).collect()} == {(0, 1)}


def test_a_restart_goes_on_from_the_log(spark, tmp_path):
    """Batches before and after a restart give the state of one run; a batch that was logged and not committed is applied once."""
    batches = [UpdateBatch().add(0, 1).add(1, 2).add(0, 2), UpdateBatch().remove(1, 2).add(2, 3), UpdateBatch().add(1, 2).add(1, 3)]
    frames = [b.frame(spark, k) for k, b in enumerate(batches)]

    def maintainer():
        g = Graph(spark, 4, False)
        kept = maintained.IncrementalTriangleCount(g, 0)
        return g, kept, StreamingMaintainer([kept], lambda: g.arcs(), f"{tmp_path}/out", LogStore(spark, f"{tmp_path}/log"))

    frames[0].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    g, kept, runner = maintainer()
    runner.start(read_updates(spark, f"{tmp_path}/in", 1), f"{tmp_path}/cp").awaitTermination(100)
    assert runner.done == 0 and kept.value == 1
    runner.log.append(frames[1], 1)  # Lost after the log and before the answer.
    (tmp_path / "log" / "v=2").mkdir()  # Begun and never completed.
    for f in frames[1:]:
        f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    g, kept, runner = maintainer()
    assert (runner.done, g.version, kept.value) == (1, 2, 0)
    runner.start(read_updates(spark, f"{tmp_path}/in", 1), f"{tmp_path}/cp").awaitTermination(100)
    arcs = {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    assert (runner.done, g.version, kept.value) == (2, 3, 2)
    assert {(r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out/batch=2").collect()} == arcs | {(b, a) for a, b in arcs}
    assert spark.read.parquet(f"{tmp_path}/out/batch=1").count() == 6


def test_the_log_keeps_the_order_of_several_versions_in_a_batch(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    assert store.last() is None
    store.append(schema.updates_frame(spark, [(3, 0, 0, 1, False, 0), (2, 9, 0, 1, True, 0), (2, 4, 5, 6, False, 0), (2, 5, 5, 6, True, 0)]), 7)
    assert store.last() == 7
    assert {(r.src, r.dst) for r in store.snapshot(7, True).collect()} == {(5, 6)}
