"""Queries of sources, sinks, graph state, codecs, generators and policies, each through its operator, with their SQL."""

from __future__ import annotations

import hashlib
import tempfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as c
from . import schema
from .functions import codec
from .operators import generators, maintained, streams, traversal
from .operators import graph as gr
from .operators.temporal import TemporalGraph
from .operators.weighted import WeightedGraph
from .plans import fixpoint, planner
from .sources import files, memory, text

query = c.query


# Sources and sinks: tables are written in a format and read back by the engine's reader.


def _lines(df: DataFrame, *columns: str, junk: tuple[str, ...] = ()) -> str:
    """Path of a text file with the columns, parted by blanks, and some lines of junk."""
    spark = df.sparkSession
    path = fixpoint.scratch(spark, "lines")
    rows = df.select(F.concat_ws(" ", *columns).alias("value"))
    rows.unionByName(spark.createDataFrame([(j,) for j in junk], "value string")).write.text(path)
    return path


@query(f"with {c.ARCS} select * from arcs")
def io_edge_list_strict(spark, sf):
    return text.load_edge_list(spark, _lines(c.customer_stream(spark, sf), "src", "dst", junk=("# a comment", "", "  % another", " \t"))).arcs()


@query(f"with {c.CUST} select src, dst, count(*) as n from st group by all")
def io_edge_list_lenient(spark, sf):
    path = _lines(c.customer_stream(spark, sf), "src", "dst", "pos", junk=("# 1 2", "one two", "7", "-1 4", "5 99999999999"))
    return text.read_lenient(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {c.CUST} select src, dst, count(*) as n, sum(floor(price)::bigint)::bigint as weight from st group by all")
def io_weighted_list(spark, sf):
    path = _lines(c.customer_stream(spark, sf).withColumn("w", F.floor("price").cast("long")), "src", "dst", "w", junk=("1 2", "1 2 x", "# 1 2 3", "1 2 -3"))
    return text.read_weighted(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(f"with {c.CHANGES} select op as is_add, count(*) as n, sum(src)::bigint as tails, sum(dst)::bigint as heads from clog group by op")
def io_mutation_list(spark, sf):
    log = c.change_log(spark, sf).withColumn("op", F.when(F.col("add"), "a").otherwise("d"))
    got = text.read_mutations(spark, _lines(log, "op", "src", "dst", junk=("x 1 2", "a 1", "# a 1 2", "a one 2")))
    return got.groupBy(F.col("add").alias("is_add")).agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("tails"), F.sum("dst").alias("heads"))


@query(f"with {c.ARCS} select * from arcs")
def io_parquet_snapshot(spark, sf):
    path = fixpoint.scratch(spark, "snapshot")
    files.save_graph(gr.Graph.from_edges(c.customer_stream(spark, sf)), path)
    return files.load_graph(spark, path).arcs()


@query(f"with {c.SPARSE} select * from arcs")
def io_binary_file(spark, sf):
    """The compact file is for graphs that fit the driver, so this takes the sparse one."""
    path = f"{tempfile.mkdtemp(prefix='evograph-')}/graph.bin"
    files.save_binary(gr.Graph.from_edges(c.sparse_arcs(spark, sf)), path)
    return files.load_binary(spark, path).arcs()


def _pairs(spark, sf) -> np.ndarray:
    return c.customer_stream(spark, sf).where("price > 480000").select("src", "dst").toPandas().to_numpy()


@query(f"with {c.SPARSE} select * from arcs")
def io_numpy(spark, sf):
    return memory.from_numpy_edges(spark, _pairs(spark, sf)).arcs()


@query(f"with {c.SPARSE} select * from arcs")
def io_scipy_csr(spark, sf):
    """From the three arrays of a square sparse matrix."""
    n, rows = c.customers(spark, sf), c.sparse_arcs(spark, sf).orderBy("src", "dst").toPandas().to_numpy()
    matrix = SimpleNamespace(shape=(n, n), indptr=np.searchsorted(rows[:, 0], np.arange(n + 1)), indices=rows[:, 1])
    return memory.from_scipy_csr(spark, matrix).arcs()


@query(f"with {c.SPARSE} select * from arcs")
def io_arrow_columns(spark, sf):
    pairs = _pairs(spark, sf)
    return memory.from_arrow_columns(spark, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])).arcs()


@query(f"with {c.SPARSE} select * from arcs")
def io_arrow_table(spark, sf):
    pairs = _pairs(spark, sf)
    return memory.from_arrow_table(spark, pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}), "a", "b").arcs()


def _names(spark, sf) -> bytes:
    return "\n".join(r[0] for r in c.table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()).encode()


NAMES = "p as (select string_agg(n_name, chr(10) order by n_nationkey) as t from nation)"


@query(f"with {NAMES} select 7::bigint as number, strlen(t)::bigint as bytes, sha256(t) as sha256 from p")
def io_partition_file(spark, sf):
    path = f"{tempfile.mkdtemp(prefix='evograph-')}/7.part"
    files.write_partition(path, 7, _names(spark, sf))
    payload = files.read_partition(path, 7)
    return spark.createDataFrame([(7, len(payload), hashlib.sha256(payload).hexdigest())], "number long, bytes long, sha256 string")


@query(f"with {NAMES} select sha256(t) as sha256 from p")
def io_dataset_digest(spark, sf):
    folder = tempfile.mkdtemp(prefix="evograph-")
    raw = _names(spark, sf)
    with open(f"{folder}/source", "wb") as out:
        out.write(raw)
    return spark.createDataFrame([(files.prepare_dataset(f"{folder}/source", f"{folder}/copy", hashlib.sha256(raw).hexdigest()),)], "sha256 string")


@query("select strlen(n_name) + 1 as length, sha256(n_name || chr(10)) as sha256 from nation")
def io_file_digests(spark, sf):
    path = fixpoint.scratch(spark, "names")
    c.table(spark, sf, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return files.file_digests(spark, path + "/*/*.txt").select("length", "sha256")


@query(f"with {c.ARCS} select src as v, count(*) as degree from arcs group by src")
def io_json_results(spark, sf):
    path = fixpoint.scratch(spark, "json")
    files.write_results(gr.degrees(c.customer_arcs(spark, sf)), path, "json")
    return spark.read.schema("v long, degree long").json(path)


@query(f"with {c.ARCS} select src as v, count(*) as degree from arcs group by src")
def io_csv_results(spark, sf):
    path = fixpoint.scratch(spark, "csv")
    files.write_results(gr.degrees(c.customer_arcs(spark, sf)), path, "csv")
    return spark.read.schema("v long, degree long").csv(path, header=True)


# Graph state.


@query(f"with {c.ARCS} select (select max(src) + 1 from arcs) as vertices, count(*) as arcs, 1::bigint as version from arcs")
def bulk_load(spark, sf):
    g = gr.Graph.from_edges(c.customer_stream(spark, sf))
    return spark.createDataFrame([(g.n, g.edge_entry_count(), g.version)], "vertices long, arcs long, version long")


def _nations(spark, sf, directed: bool = False) -> gr.Graph:
    return gr.Graph.from_edges(c.table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst")), directed)


NATIONS = "ed as (select n_nationkey::bigint as a, n_regionkey::bigint + 100 as b from nation)"
BOTH = "select a as src, b as dst from e union select b, a from e"


@query(f"with {NATIONS}, e as (select * from ed where a <> 3 union select 0, 1 union select 30, 31) {BOTH}")
def single_edge_changes(spark, sf):
    g = _nations(spark, sf)
    g.add_edge(1, 0)
    g.add_edge(30, 31)
    g.add_edge(31, 30)
    g.remove_edge(*next((r.src, r.dst) for r in g.arcs().where("src = 3").collect()))
    g.remove_edge(50, 51)
    return g.arcs()


@query(f"with {NATIONS} select 9001::bigint as vertices, 2 * count(*) + 2 as arcs from ed")
def growth(spark, sf):
    g = _nations(spark, sf)
    g.ensure_vertex(5_000)
    g.add_edge(0, 9_000)
    g.ensure_vertex(10)
    return spark.createDataFrame([(g.n, g.edge_entry_count())], "vertices long, arcs long")


@query(f"with {c.ARCS} select dst as v, count(*) as tails from arcs where src % 50 = 0 group by dst")
def frontier_step(spark, sf):
    g = gr.Graph.from_edges(c.customer_stream(spark, sf))
    frontier = g.vertices().where("v % 50 = 0").withColumnRenamed("v", "src")
    return g.arcs().join(frontier, "src").groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("tails"))


@query(f"with {NATIONS}, e as (select * from ed), arcs as ({BOTH}) select src as v, string_agg(dst::varchar, ',' order by dst) as neighbors from arcs where src in (0, 7, 100, 104) group by src union all select 105, 'no vertex 105'")
def checked_neighbors(spark, sf):
    g, rows = _nations(spark, sf), []
    for v in (0, 7, 100, 104, 105):
        try:
            rows.append((v, ",".join(map(str, g.checked_neighbors(v)))))
        except IndexError as e:
            rows.append((v, str(e)))
    return spark.createDataFrame(rows, "v long, neighbors string")


def _changed(spark, sf) -> gr.Graph:
    g, batches = c._maintained_graph(spark, sf)
    g.compact()
    for b in batches:
        g.apply(b)
    return g


@query(f"with {c.CHANGES} select count(*) as arcs, true as had_overlay, 0::bigint as overlay, true as same from arcs")
def compaction(spark, sf):
    g = _changed(spark, sf)
    before, had = g.digest(), g.delta_edge_count() > 0
    g.compact()
    return spark.createDataFrame([(g.edge_entry_count(), had, g.delta_edge_count(), before == g.digest())], "arcs long, had_overlay boolean, overlay long, same boolean")


@query(f"with {c.CHANGES} select src, dst from arcs")
def row_compaction(spark, sf):
    g = _changed(spark, sf)
    g.maybe_compact(0.05)
    return g.arcs()


@query(f"with {c.CHANGES} select src, dst from arcs")
def automatic_maintenance(spark, sf):
    g = _changed(spark, sf)
    g.maintain(1, 0.0)
    return g.arcs()


@query(f"with {c.CHANGES} select count(*) as arcs, true as same from arcs")
def consolidation_digest(spark, sf):
    g = _changed(spark, sf)
    n, mark = g.digest()
    return spark.createDataFrame([(n, g.consolidated().digest() == (n, mark))], "arcs long, same boolean")


@query(f"with {c.CHANGES} select src, dst, w from warcs where src < 4")
def weight_lookup(spark, sf):
    g = WeightedGraph(spark, c.customers(spark, sf), False)
    log = c.change_log(spark, sf)
    for version in (1, 2, 3):
        g.apply(log.where(F.col("version") == version))
    rows = [(v, dst, g.weight(v, dst)) for v in range(4) for dst, _ in g.neighbors(v)]
    return spark.createDataFrame(rows, "src long, dst long, w long")


@query(f"with {NATIONS}, e as (select * from ed where a < 20 and a % 2 = 1 union select a, b from ed where a = 20) {BOTH}")
def temporal_apply(spark, sf):
    """Versions recorded batch by batch; the second of three is asked for."""
    rows = [(r[0], r[1] + 100) for r in c.table(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    g = TemporalGraph(spark)
    first, second, third = gr.UpdateBatch(), gr.UpdateBatch(), gr.UpdateBatch()
    for a, b in rows[:20]:
        first.add(a, b, 10)
    for a, b in rows[:20:2]:
        second.remove(a, b, 20)
    second.add(*rows[20], 20)
    third.add(*rows[21], 30)
    for batch in (first, gr.UpdateBatch(), second, third):
        g.apply(batch)
    return g.snapshot_version(2)


# Solvers in full, and what the maintained forms report.


@query(c._sql["triangles_incremental"])
def triangles_full_solver(spark, sf):
    kept = maintained.IncrementalTriangleCount(_changed(spark, sf), 0)
    kept.recompute()
    return spark.createDataFrame([(kept.value,)], "triangles long")


@query(c._sql["components_incremental"])
def components_full_solver(spark, sf):
    return maintained.IncrementalComponents(_changed(spark, sf)).labels


@query(c._sql["sssp_incremental"])
def sssp_full_solver(spark, sf):
    return maintained.IncrementalSSSP(_changed(spark, sf), 0).distances


@query(c._sql["bfs_incremental"])
def bfs_fallback(spark, sf):
    """With no share of affected vertices allowed, every deletion that affects any falls back to a full search."""
    log = c.user_log(spark, sf)
    g = gr.Graph(spark, 0, True)
    g.apply(log.where("version <= 28"))
    kept = maintained.IncrementalBFS(g, 0, 0.0)
    kept.apply(log.where("version > 28"))
    return kept.distances


@query(f"with recursive {c.CHANGES}, {c.BFS} select count(distinct v) as reached, true as counted from bfs")
def bfs_getters(spark, sf):
    g, batches = c._maintained_graph(spark, sf)
    kept = maintained.IncrementalBFS(g, 0)
    for b in batches:
        kept.apply(b)
    return spark.createDataFrame([(kept.reachable_count, kept.last_affected_vertices >= 0 and kept.last_deletion_candidates >= 0)], "reached long, counted boolean")


@query("select unnest(['components', 'kcore', 'triangles']) as form, true as rejected")
def directed_rejected(spark, sf):
    g, rows = _nations(spark, sf, True), []
    for name, form in (("components", maintained.IncrementalComponents), ("kcore", maintained.IncrementalKCore), ("triangles", maintained.IncrementalTriangleCount)):
        try:
            form(g)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "form string, rejected boolean")


# Policies over a trace made from the user log: a day is a batch, and its arms' costs follow from its operations.

TRACE = f"{c.LOG}, t as (select version::bigint as batch, count(*) as updates, count(*) / 20000.0::double as update_fraction, (3 * count(*))::double as incremental_us, (200 + version * 40)::double as full_us from log group by version)"


def _trace(spark, sf) -> list[dict]:
    rows = c.user_log(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("n")).orderBy("version").collect()
    return [{"batch": r.version, "updates": r.n, "update_fraction": r.n / 20000.0, "incremental_us": 3.0 * r.n, "full_us": 200.0 + 40 * r.version} for r in rows]


@query(f"""with {TRACE}, p as (select *, unnest(['always_incremental', 'always_full', 'simple_threshold']) as policy from t),
d as (select *, policy = 'always_full' or (policy = 'simple_threshold' and update_fraction >= {planner.FULL_UPDATE}) as explicit_full, full_us <= incremental_us as oracle_full, least(full_us, incremental_us) as best from p),
k as (select *, case when explicit_full then full_us else incremental_us end as cost_us from d)
select policy, batch, explicit_full, cost_us, oracle_full, round((cost_us - best) / best, 9) as regret from k""")
def policies_simple(spark, sf):
    rows = [r for name in ("always_incremental", "always_full", "simple_threshold") for r in planner.replay(name, _trace(spark, sf), 5_000, 150.0)]
    return spark.createDataFrame([(r["policy"], r["batch"], r["full"], float(r["cost"]), r["oracle_full"], round(float(r["regret"]), 9)) for r in rows], "policy string, batch long, explicit_full boolean, cost_us double, oracle_full boolean, regret double")


# Codecs.


def _coded(lists: DataFrame, of) -> DataFrame:
    """(v, neighbors): lists through ``of`` and back, in Arrow batches."""

    def run(batches):
        for batch in batches:
            got = [",".join(map(str, of(x).tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["v", "neighbors"])

    return lists.select("v", "neighbors").mapInArrow(run, "v long, neighbors string")


@query(c._sql["neighbors_sorted"])
def codec_blocked_varbyte(spark, sf):
    return _coded(gr.neighbor_lists(c.customer_arcs(spark, sf)), lambda x: codec.blocked_varbyte_decode(*codec.blocked_varbyte(x, 16)))


@query(c._sql["neighbors_sorted"])
def codec_fixed_decode(spark, sf):
    return _coded(gr.neighbor_lists(c.customer_arcs(spark, sf)), lambda x: codec.fixed_decode(*codec.fixed_encode(x, 16)))


@query(f"with {c.ARCS}, d as (select src, dst, dst - lag(dst, 1, 0) over (partition by src order by dst) as gap from arcs) select src as v, string_agg(gap::varchar, ',' order by dst) as neighbors from d group by src")
def codec_deltas(spark, sf):
    return _coded(gr.neighbor_lists(c.customer_arcs(spark, sf)), codec.deltas)


@query(f"with {c.ARCS}, {c.SIZES} select v, round(n * 4 / varbyte_bytes, 9) as ratio from z")
def codec_ratio(spark, sf):
    lists = gr.neighbor_lists(c.customer_arcs(spark, sf))

    def run(batches):
        for batch in batches:
            got = [codec.ratio(len(x), len(codec.varbyte_encode(codec.deltas(x)))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["v", "ratio"])

    return lists.select("v", "neighbors").mapInArrow(run, "v long, ratio double").select("v", F.round("ratio", 9).alias("ratio"))


@query(f"with recursive {c.ARCS}, {c.BFS} select v, min(d) as d from bfs group by v")
def bfs_over_encoded_lists(spark, sf):
    lists = fixpoint.cut(codec.encode_lists(gr.neighbor_lists(c.customer_arcs(spark, sf))).select("v", "varbyte"))
    return traversal.bfs_encoded(lists, 0)


# Streams.


@query(f"""with {c.LOG}, ed as (select version, seq, src, dst from log where src <> dst), ids as (select id, row_number() over (order by id) - 1 as n from (select src as id from ed union select dst from ed))
select x.n as src, y.n as dst, version, seq from ed join ids x on x.id = src join ids y on y.id = dst""")
def pinned_stream(spark, sf):
    return streams.pinned(c.user_log(spark, sf).where("src <> dst").select("src", "dst", "version", "seq"))


@query(f"""with {c.CUST}, p as (select least(src, dst) as a, greatest(src, dst) as b, 2 * min(pos) as pos from st where src <> dst group by all)
select pos, 0 as k, a as src, b as dst from p union all select pos, 1, b, a from p""")
def symmetric_stream(spark, sf):
    first = streams.first_occurrences(c.customer_stream(spark, sf))
    back = first.select((F.col("pos") * 2 + 1).alias("pos"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return streams.symmetric_stream(first.withColumn("pos", F.col("pos") * 2).unionByName(back))


@query(c._sql["edge_relabel"])
def external_stream(spark, sf):
    """Ids that are dense pass; the relabelled edges are."""
    return streams.external_stream(streams.normalize(c.user_log(spark, sf)))


@query(f"""with {c.ARCS}, n as (select count(*) as n from customer), l as (select src, min(dst) as old, list(dst) as every from arcs group by src),
k as (select src, old, every, unnest(range(1, len(every) + 3)) as k from l), f as (select src, old, min(k) as k from k, n where not list_contains(every, (old + k) % n) and (old + k) % n <> src group by all)
select src, old as dst, false as is_add from f union all select src, (old + k) % n, true from f, n""")
def row_replacement_stream(spark, sf):
    n = c.customers(spark, sf)
    return streams.row_replacements(c.customer_arcs(spark, sf), n, n, 1).withColumnRenamed("add", "is_add")


# Generators; draws are the first 48 bits of an md5, as in SQL.


def _u(n: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::bigint % {n})"


def _one_way(sql: str) -> str:
    return f"select distinct least(src, dst) as src, greatest(src, dst) as dst from ({sql}) where src <> dst"


@query(f"""with v as (select range as src, range // 20 as r, range % 20 as c from range(400)), g as (select src, r * 20 + (c + 1) % 20 as dst from v union all select src, (r + 1) % 20 * 20 + c from v)
select distinct src, dst from (select src, dst from g union all select dst, src from g union all select {_u(400, '1', "'a'", 'range')}, {_u(400, '1', "'b'", 'range')} from range(100)) where src <> dst""")
def grid_graph(spark, sf):
    return generators.grid_with_shortcuts(spark, 20)


@query(_one_way(f"select range as src, (range + k) % 400 as dst from range(400), (select unnest(range(1, 5)) as k) union all select range, {_u(400, '1', 'range')} from range(400)"))
def ring_graph(spark, sf):
    return generators.ring_lattice(spark, 400)


@query(f"""select distinct src, dst from (select range as src, range + 1 as dst from range(399) union all select range + 1, range from range(399) union all select range % 8, range from range(400) where range % 16 = 0
union all select {_u(400, '1', "'a'", 'range')}, {_u(400, '1', "'b'", 'range')} from range(50)) where src <> dst""")
def chain_graph(spark, sf):
    return generators.chain_with_hubs(spark, 400)


@query(_one_way(f"select range as src, range // 50 * 50 + {_u(50, '1', 'range', 'k')} as dst from range(400), (select unnest(range(1, 5)) as k) union all select range, range // 50 * 50 from range(400) union all select range * 50, (range + 1) % 8 * 50 from range(8)"))
def block_graph(spark, sf):
    return generators.block_communities(spark, 8, 50)


@query(f"""with b as (select range as id, k, {_u(1 << 30, '1', 'k', 'range')} / {1 << 30}::double as u from range(4000), (select unnest(range(9)) as k)),
e as (select id, sum(case when u >= 0.57::double + 0.19::double then 1 << (8 - k) else 0 end)::bigint as src, sum(case when (u >= 0.57 and u < 0.57::double + 0.19::double) or u >= 0.57::double + 0.19::double + 0.19::double then 1 << (8 - k) else 0 end)::bigint as dst from b group by id)
select distinct src, dst from e where src <> dst""")
def rmat_graph(spark, sf):
    return generators.rmat(spark, 9, 4000)


def _drawn(k: int, top: int) -> str:
    return f"select range as src, {_u(top, '1', 'range', 'k')} as dst from range(40), (select unnest(range(1, {k + 1})) as k)"


@query(f"""select 'random' as name, src, dst from ({_drawn(2, 40)}) where src <> dst union all select 'destructive', src, dst from ({_drawn(4, 40)}) where src <> dst
union all select 'disconnected', src, dst + src // 10 * 10 from ({_drawn(2, 10)}) where src <> dst and src <> dst + src // 10 * 10
union all select 'hub', 0, range from range(1, 40) union all select 'path', range, range + 1 from range(39) union all select 'dense', src, dst from ({_drawn(20, 40)}) where src <> dst""")
def stress_graphs(spark, sf):
    parts = [df.select(F.lit(name).alias("name"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")) for name, df in generators.stress_topologies(spark).items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


_M = "18446744073709551616::uhugeint"


@query(f"""with a as (select range as id, (range + 1)::uhugeint + 11400714819323198485::uhugeint as z from range(1000)), b as (select id, z % {_M} as z from a),
d as (select id, (xor(z, z >> 30) * 13787848793156543929::uhugeint) % {_M} as z from b), e as (select id, (xor(z, z >> 27) * 10723151780598845931::uhugeint) % {_M} as z from d), f as (select id, xor(z, z >> 31) as z from e)
select id, (z::hugeint - 9223372036854775808::hugeint)::bigint as _order from f""")
def splitmix_order(spark, sf):
    return generators.permutation_order(spark.range(1000), "id")
