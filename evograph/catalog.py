"""Queries by name over the provided tables, and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schema
from .functions import codec, decisions
from .operators import components as cc
from .operators import generators, kcore, maintained, pagerank, reports, similarity, streams, traversal
from .operators import graph as gr
from .operators.temporal import TemporalGraph
from .operators.weighted import WeightedGraph
from .plans import consolidation, fixpoint, planner

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _whole_counts(sql: str) -> str:
    """``count_if`` gives a 128-bit number in the SQL engine; make it a bigint, as it is here."""
    at = 0
    while (at := sql.find("count_if(", at)) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:end]}::bigint{sql[end:]}"
        at += len("count_if(")
    return sql


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = _whole_counts(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Graphs derived from the tables.


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, src, dst, price): customers of consecutive orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("price"))
    o = o.withColumn("_b", F.floor(F.col("pos") / 65536))
    return streams.ordered_lead(o, "_b", ["pos"], ["src"]).where("next_src is not null").select("pos", "src", F.col("next_src").alias("dst"), "price")


def customer_arcs(spark: SparkSession, sf: str) -> DataFrame:
    return schema.simple_arcs(customer_stream(spark, sf), False)


def sparse_arcs(spark: SparkSession, sf: str) -> DataFrame:
    return schema.simple_arcs(customer_stream(spark, sf).where("price > 480000"), False)


def weighted_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """Arcs with the last weight, the whole price of the order."""
    log = customer_stream(spark, sf).select(F.lit(0).cast("long").alias("version"), F.col("pos").alias("seq"), "src", "dst", F.floor("price").cast("long").alias("weight"), F.lit(True).alias("add"))
    from .operators.weighted import weighted_snapshot

    return weighted_snapshot(log, False)


def customers(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "customer").count()


def user_log(spark: SparkSession, sf: str) -> DataFrame:
    """Updates (version, seq, src, dst, add, ts): users of consecutive events; errors remove, a day is a version."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type").withColumn("day", F.to_date("ts"))
    first = e.agg(F.min("day")).first()[0]
    second = F.expr("cast(extract(second from ts) * 1000000 as bigint)")
    us = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86400000000 + F.hour("ts").cast("long") * 3600000000 + F.minute("ts").cast("long") * 60000000 + second
    e = e.withColumn("ts_us", us.cast("long"))
    rows = streams.ordered_lead(e, "day", ["ts_us", "event_id"], ["user_id"]).where("next_user_id is not null")
    seq = F.row_number().over(Window.partitionBy("day").orderBy("ts_us", "event_id")).cast("long")
    return rows.select((F.datediff("day", F.lit(first)) + 1).cast("long").alias("version"), seq.alias("seq"), F.col("user_id").cast("long").alias("src"), F.col("next_user_id").cast("long").alias("dst"), (F.col("event_type") != "error").alias("add"), F.col("ts_us").alias("ts"))


def users(log: DataFrame) -> int:
    return gr.highest_id(log) + 1


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Customer edges in three versions: most are added, some removed, the last added; undirected."""
    s = customer_stream(spark, sf)
    top = s.agg(F.max("pos")).first()[0]
    row = lambda df, version, add: df.select(F.lit(version).cast("long").alias("version"), F.col("pos").alias("seq"), "src", "dst", F.floor("price").cast("long").alias("weight"), F.lit(add).alias("add"), F.lit(0).cast("long").alias("ts"))
    late = F.col("pos") * 100 >= 98 * top
    return row(s.where(~late), 1, True).unionByName(row(s.where(~late & (F.col("pos") % 97 == 0)), 2, False)).unionByName(row(s.where(late), 3, True))


CUST = "s as (select o_orderkey as pos, o_custkey as src, lead(o_custkey) over (order by o_orderkey) as dst, o_totalprice as price from orders), st as (select * from s where dst is not null)"
ARCS = f"{CUST}, arcs as (select src, dst from st where src <> dst union select dst, src from st where src <> dst)"
SPARSE = f"{CUST}, arcs as (select src, dst from st where src <> dst and price > 480000 union select dst, src from st where src <> dst and price > 480000)"
WEIGHTED = f"{CUST}, u as (select least(src, dst) as a, greatest(src, dst) as b, arg_max(floor(price)::bigint, pos) as w from st where src <> dst group by all), arcs as (select a as src, b as dst, w from u union all select b, a, w from u)"
VERTS = "verts as (select range as v from range((select count(*) from customer)))"
LOG = """ev as (select ts, event_id, user_id::bigint as src, lead(user_id) over (order by ts, event_id)::bigint as dst, event_type <> 'error' as op, epoch_us(ts) as us,
  date_diff('day', (select min(ts)::date from events), ts::date) + 1 as version, row_number() over (partition by ts::date order by ts, event_id) as seq from events),
log as (select version, seq, src, dst, op, us from ev where dst is not null)"""
CHANGES = f"""{CUST}, top as (select max(pos) as t from st),
clog as (select 1 as version, pos as seq, src, dst, floor(price)::bigint as w, true as op from st, top where not pos * 100 >= 98 * t
  union all select 2, pos, src, dst, floor(price)::bigint, false from st, top where not pos * 100 >= 98 * t and pos % 97 = 0
  union all select 3, pos, src, dst, floor(price)::bigint, true from st, top where pos * 100 >= 98 * t),
net as (select least(src, dst) as a, greatest(src, dst) as b, arg_max(op, version::bigint * 1000000000 + seq) as op, arg_max(w, version::bigint * 1000000000 + seq) as w from clog where src <> dst group by all),
warcs as (select a as src, b as dst, w from net where op union all select b, a, w from net where op), arcs as (select src, dst from warcs)"""


def fold(where: str) -> str:
    return f"select src, dst from (select src, dst, op, row_number() over (partition by src, dst order by version desc, seq desc) as rn from log where src <> dst and {where}) where rn = 1 and op"


BFS = "bfs(v, d) as (select 0::bigint, 0::bigint union select arcs.dst, bfs.d + 1 from bfs join arcs on arcs.src = bfs.v where bfs.d < 24)"
SPATH = "sp(v, d) using key (v) as (select 0::bigint, 0::bigint union select a.dst, min(sp.d + a.w)::bigint from sp join arcs a on a.src = sp.v left join recurring.sp r on r.v = a.dst where r.d is null or sp.d + a.w < r.d group by a.dst)"
COMP = "cc(v, c) using key (v) as (select v, v from verts union select a.dst, min(cc.c) from cc join arcs a on a.src = cc.v join recurring.cc r on r.v = a.dst where cc.c < r.c group by a.dst)"
CORE = """k(i, v, c) as (select 0, src, count(*) from arcs group by src union all
  select i + 1, src, max(least(c, rn)) from (select k.i, a.src, k.c, row_number() over (partition by a.src order by k.c desc) as rn from k join arcs a on a.dst = k.v where k.i < 40) group by i, src)"""


def rank_sql(rounds: int, n: str) -> str:
    return f"""deg as (select src as v, count(*) as deg from arcs group by src), ext as (select src, dst, 1.0::double as k from arcs union all select v, v, 0.0 from verts),
r(i, v, x) as (select 0, v, 1.0::double / {n} from verts union all
  select i + 1, dst, 0.15::double / {n} + 0.85::double * sum(case when k > 0 then x / deg else 0 end) + 0.85::double * max(dm) / {n}
  from (select r.i, r.v, r.x, deg.deg, sum(case when deg.deg is null then r.x else 0 end) over () as dm from r left join deg on deg.v = r.v where r.i < {rounds}) q join ext on ext.src = q.v group by i, dst)"""


# Construction and views.


@query(f"with {ARCS} select * from arcs")
def arcs_normalized(spark, sf):
    return customer_arcs(spark, sf)


@query(f"with {ARCS} select src as v, count(*) as degree from arcs group by src")
def degree(spark, sf):
    return gr.degrees(customer_arcs(spark, sf))


@query(f"with {ARCS} select count(*) as arcs, count(distinct src) as vertices, (select max(c) from (select count(*) as c from arcs group by src)) as max_degree from arcs")
def graph_counts(spark, sf):
    return gr.degrees(customer_arcs(spark, sf)).agg(F.sum("degree").cast("long").alias("arcs"), F.count(F.lit(1)).alias("vertices"), F.max("degree").alias("max_degree"))


@query(f"with {ARCS} select src as v, string_agg(dst::varchar, ',' order by dst) as neighbors from arcs group by src")
def neighbors_sorted(spark, sf):
    return gr.neighbor_lists(customer_arcs(spark, sf)).select("v", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query(f"with {LOG}, a as ({fold('true')}) select dst as v, string_agg(src::varchar, ',' order by src) as neighbors from a group by dst")
def in_neighbors_sorted(spark, sf):
    back = gr.snapshot(user_log(spark, sf), True).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return gr.neighbor_lists(back).select("v", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query(f"""with {ARCS}, probe as (select o_custkey as src, o_orderkey % (select count(*) from customer) as dst from orders where o_orderkey % 7 = 0)
select distinct src, dst, exists (select 1 from arcs a where a.src = p.src and a.dst = p.dst) as present from probe p""")
def has_edge(spark, sf):
    n = customers(spark, sf)
    probe = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst")).distinct()
    return probe.join(customer_arcs(spark, sf).withColumn("present", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("present", F.lit(False)).alias("present"))


def _split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base arcs up to version 20, overlay of what follows)."""
    return gr.snapshot(log.where("version <= 20"), True), gr.canonical(log.where("version > 20"), True)


OVER = f"""{LOG}, base as ({fold('version <= 20')}),
lastop as (select src, dst, op from (select src, dst, op, row_number() over (partition by src, dst order by version desc, seq desc) as rn from log where src <> dst and version > 20) where rn = 1),
over as (select l.src, l.dst, l.op from lastop l left join base b on b.src = l.src and b.dst = l.dst where l.op = (b.src is null))"""


@query(f"with {OVER} select src, dst, op as is_add from over")
def overlay_effective(spark, sf):
    base, last = _split(user_log(spark, sf))
    return gr.effective(last, base).select("src", "dst", F.col("add").alias("is_add"))


@query(f"with {OVER} select count(distinct src) as dirty_rows, count(*) as delta_entries, (select count(*) from base) as base_arcs from over")
def dirty_rows(spark, sf):
    base, last = _split(user_log(spark, sf))
    return gr.effective(last, base).agg(F.count_distinct("src").alias("dirty_rows"), F.count(F.lit(1)).alias("delta_entries")).withColumn("base_arcs", F.lit(base.count()).cast("long"))


@query(f"""with {OVER}, o as (select src, count(*) as overlay_entries from over group by src), b as (select src, count(*) as base_entries from base group by src)
select o.src, overlay_entries, coalesce(base_entries, 0) as base_entries, overlay_entries / greatest(8, coalesce(base_entries, 0)) as density
from o left join b using (src) where overlay_entries / greatest(8, coalesce(base_entries, 0)) >= 0.25""")
def compaction_candidates(spark, sf):
    base, last = _split(user_log(spark, sf))
    return gr.compaction_candidates(base, gr.effective(last, base))


@query(f"with {LOG} {fold('true')}")
def consolidated_snapshot(spark, sf):
    log = user_log(spark, sf)
    g = gr.Graph(spark, 0, True)
    for part in (log.where("version <= 20"), log.where("version > 20")):
        g.apply(part)
    return g.consolidated().arcs()


@query(f"with {WEIGHTED} select * from arcs")
def weighted_last_value(spark, sf):
    return weighted_arcs(spark, sf)


# Time travel.


def temporal(spark, sf) -> TemporalGraph:
    return TemporalGraph.over(user_log(spark, sf), True)


MID = "(select (min(us) + max(us)) // 2 from log)"


def middle(g: TemporalGraph) -> int:
    low, high = g.log.agg(F.min("ts"), F.max("ts")).first()
    return (low + high) // 2


@query(f"with {LOG} {fold('version <= 15')}")
def snapshot_version(spark, sf):
    return temporal(spark, sf).snapshot_version(15)


@query(f"with {LOG} {fold(f'us <= {MID}')}")
def snapshot_time(spark, sf):
    g = temporal(spark, sf)
    return g.snapshot_time(middle(g))


@query(f"with {LOG} select version, seq, src, dst, op as is_add, us as ts from log where version > 10 and version <= 12")
def changes_versions(spark, sf):
    return temporal(spark, sf).changes_between_versions(10, 12).withColumnRenamed("add", "is_add")


@query(f"with {LOG} select version, seq, src, dst, op as is_add, us as ts from log where us > {MID} and us <= {MID} + 86400000000")
def changes_times(spark, sf):
    g = temporal(spark, sf)
    return g.changes_between_times(middle(g), middle(g) + 86_400_000_000).withColumnRenamed("add", "is_add")


@query(f"with {LOG} {fold(f'us > {MID} - 7 * 86400000000 and us <= {MID}')}")
def sliding_window(spark, sf):
    g = temporal(spark, sf)
    return g.sliding_window(middle(g), 7 * 86_400_000_000)


@query(f"with {LOG} select version, min(us) as min_ts, max(us) as max_ts, count(*) as n_ops from log group by version")
def history(spark, sf):
    return temporal(spark, sf).history()


# Traversal.


@query(f"with recursive {ARCS}, {VERTS}, {BFS} select verts.v, coalesce(min(bfs.d), {schema.UNREACHABLE}) as d from verts left join bfs on bfs.v = verts.v group by verts.v")
def bfs_distances(spark, sf):
    return traversal.bfs_distances(customer_arcs(spark, sf).persist(), customers(spark, sf), 0)


@query(f"with recursive {ARCS}, {BFS} select d, count(*) as n from (select v, min(d) as d from bfs group by v) group by d")
def bfs_layers(spark, sf):
    return traversal.layers(traversal.bfs_distances(customer_arcs(spark, sf).persist(), customers(spark, sf), 0))


@query(f"""with recursive {ARCS}, m(source, v, d) as (select range, range, 0::bigint from range(4) union select m.source, arcs.dst, m.d + 1 from m join arcs on arcs.src = m.v where m.d < 12)
select source, v, min(d) as d from m group by all""")
def bfs_multi_source(spark, sf):
    return traversal.bfs(customer_arcs(spark, sf).persist(), spark.range(4).select(F.col("id").alias("source"), F.col("id").alias("v")), ("source",))


@query(f"with recursive {SPARSE}, first as (select min(src) as f from arcs), b(v, d) as (select f, 0::bigint from first union select arcs.dst, b.d + 1 from b join arcs on arcs.src = b.v where b.d < 60) select count(distinct v) as reached, count(distinct v) / (select count(*) from customer) as fraction from b")
def reachable(spark, sf):
    arcs, n = sparse_arcs(spark, sf).persist(), customers(spark, sf)
    return traversal.reach(traversal.bfs_distances(arcs, n, arcs.agg(F.min("src")).first()[0]), n)


@query(f"with recursive {WEIGHTED}, {VERTS}, {SPATH} select verts.v, coalesce(sp.d, {schema.INFINITY}) as d from verts left join sp on sp.v = verts.v")
def sssp_weighted(spark, sf):
    return traversal.sssp_distances(weighted_arcs(spark, sf).persist(), customers(spark, sf), 0)


@query(f"with recursive {ARCS}, {VERTS}, {BFS} select verts.v, coalesce(min(bfs.d), {schema.INFINITY}) as d from verts left join bfs on bfs.v = verts.v group by verts.v")
def sssp_unweighted(spark, sf):
    return traversal.sssp_distances(customer_arcs(spark, sf).persist(), customers(spark, sf), 0, weighted=False)


# Whole-graph analytics.


@query(f"with recursive {SPARSE}, {VERTS}, {COMP} select v, dense_rank() over (order by c) - 1 as component from cc")
def components(spark, sf):
    return cc.connected_components(sparse_arcs(spark, sf), schema.vertices(spark, customers(spark, sf)))


@query(f"with recursive {SPARSE}, {VERTS}, {COMP} select c as component, count(*) as n from cc group by c")
def component_sizes(spark, sf):
    return cc.sizes(cc.min_labels(sparse_arcs(spark, sf), schema.vertices(spark, customers(spark, sf))))


@query(f"with recursive {ARCS}, {VERTS}, {rank_sql(10, '(select count(*) from customer)')} select v, round(x, 8) as rank from r where i = 10")
def pagerank_fixed(spark, sf):
    return pagerank.fixed_rounds(customer_arcs(spark, sf), customers(spark, sf), 10).select("v", F.round("rank", 8).alias("rank"))


@query(f"with recursive {SPARSE}, {VERTS}, {rank_sql(12, '(select count(*) from customer)')} select v, round(x, 8) as rank from r where i = 12")
def pagerank_dangling(spark, sf):
    return pagerank.fixed_rounds(sparse_arcs(spark, sf), customers(spark, sf), 12).select("v", F.round("rank", 8).alias("rank"))


@query(f"with {SPARSE}, {VERTS} select count(*) as dangling from verts where v not in (select src from arcs)")
def dangling_count(spark, sf):
    n = customers(spark, sf)
    return sparse_arcs(spark, sf).agg((F.lit(n) - F.count_distinct("src")).alias("dangling"))


TRI = "(select count(*) from arcs x join arcs y on x.dst = y.src join arcs z on z.src = x.src and z.dst = y.dst where x.src < x.dst and y.src < y.dst)"


@query(f"with {ARCS} select {TRI} as triangles")
def triangle_count(spark, sf):
    return similarity.triangle_count(customer_arcs(spark, sf))


PAIRS = "pairs as (select range % 50 as a, (range * 7 + 1) % 60 as b from range(200) where range % 50 <> (range * 7 + 1) % 60 group by all)"


def probe_pairs(spark) -> DataFrame:
    return spark.range(200).select((F.col("id") % 50).alias("a"), ((F.col("id") * 7 + 1) % 60).alias("b")).where("a <> b").distinct()


COMMON = "com as (select p.a, p.b, count(y.dst) as common from pairs p left join arcs x on x.src = p.a left join arcs y on y.src = p.b and y.dst = x.dst group by p.a, p.b)"


@query(f"with {ARCS}, {PAIRS}, {COMMON} select * from com")
def common_neighbors(spark, sf):
    return similarity.common_neighbors(customer_arcs(spark, sf), probe_pairs(spark))


@query(f"with {ARCS}, {PAIRS}, {COMMON}, g as (select src, count(*) as n from arcs group by src) select a, b, common, coalesce(common / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - common, 0), 0.0)::double as jaccard from com left join g x on x.src = a left join g y on y.src = b")
def jaccard(spark, sf):
    return similarity.jaccard(customer_arcs(spark, sf), probe_pairs(spark))


@query(f"with recursive {ARCS}, {VERTS}, {CORE} select verts.v, coalesce(k.c, 0) as core from verts left join k on k.v = verts.v and k.i = 40")
def kcore_numbers(spark, sf):
    return kcore.core_numbers(customer_arcs(spark, sf), schema.vertices(spark, customers(spark, sf)))


# Maintained analytics; the SQL computes the final graph's answer from nothing.


def _maintained_graph(spark, sf) -> tuple[gr.Graph, list[DataFrame]]:
    log = change_log(spark, sf).persist()
    g = gr.Graph(spark, customers(spark, sf), False)
    plain = log.drop("weight")
    g.apply(plain.where("version = 1"))
    return g, [plain.where("version = 2"), plain.where("version = 3")]


@query(f"with recursive {LOG}, arcs as ({fold('true')}), verts as (select range as v from range((select max(greatest(src, dst)) + 1 from log where src <> dst))), {BFS} select verts.v, coalesce(min(bfs.d), {schema.UNREACHABLE}) as d from verts left join bfs on bfs.v = verts.v group by verts.v")
def bfs_incremental(spark, sf):
    log = user_log(spark, sf).persist()
    g = gr.Graph(spark, 0, True)
    g.apply(log.where("version <= 28"))
    kept = maintained.IncrementalBFS(g, 0)
    for version in (29, 30, 31):
        kept.apply(log.where(F.col("version") == version))
    return kept.distances


@query(f"with recursive {CHANGES}, {VERTS}, {BFS} select verts.v, coalesce(min(bfs.d), {schema.INFINITY}) as d from verts left join bfs on bfs.v = verts.v group by verts.v")
def sssp_incremental(spark, sf):
    g, batches = _maintained_graph(spark, sf)
    kept = maintained.IncrementalSSSP(g, 0)
    for b in batches:
        kept.apply(b)
    return kept.distances


@query(f"with recursive {CHANGES.replace('arcs as (select src, dst from warcs)', 'arcs as (select * from warcs)')}, {VERTS}, {SPATH} select verts.v, coalesce(sp.d, {schema.INFINITY}) as d from verts left join sp on sp.v = verts.v")
def weighted_sssp_incremental(spark, sf):
    log = change_log(spark, sf).persist()
    g = WeightedGraph(spark, customers(spark, sf), False)
    g.apply(log.where("version = 1"))
    kept = maintained.IncrementalWeightedSSSP(g, 0)
    for version in (2, 3):
        kept.apply(log.where(F.col("version") == version))
    return kept.distances


@query(f"with recursive {CHANGES}, {VERTS}, {COMP} select v, c as component from cc")
def components_incremental(spark, sf):
    g, batches = _maintained_graph(spark, sf)
    kept = maintained.IncrementalComponents(g)
    for b in batches:
        kept.apply(b)
    return kept.labels


@query(f"with {CHANGES} select {TRI} as triangles")
def triangles_incremental(spark, sf):
    g, batches = _maintained_graph(spark, sf)
    kept = maintained.IncrementalTriangleCount(g)
    for b in batches:
        kept.apply(b)
    return spark.createDataFrame([(kept.value,)], "triangles long")


@query(f"with recursive {CHANGES}, {VERTS}, {CORE} select verts.v, coalesce(k.c, 0) as core from verts left join k on k.v = verts.v and k.i = 40")
def kcore_incremental(spark, sf):
    g, batches = _maintained_graph(spark, sf)
    kept = maintained.IncrementalKCore(g)
    for b in batches:
        kept.apply(b)
    return kept.cores


@query(f"with recursive {CHANGES}, {VERTS}, {rank_sql(70, '(select count(*) from customer)')} select v, round(x, 6) as rank from r where i = 70")
def pagerank_incremental(spark, sf):
    g, batches = _maintained_graph(spark, sf)
    kept = maintained.IncrementalPageRank(g, tolerance=1e-10)
    for b in batches:
        kept.apply_validated(b)
    return kept.ranks.select("v", F.round("rank", 6).alias("rank"))


# Planning.


DIST = f"{LOG}, arcs as ({fold('version <= 28')}), {BFS}, dist as (select v, min(d) as d from bfs group by v), batch as (select * from log where version = 29)"


def _before_batch(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = user_log(spark, sf).persist()
    arcs = gr.snapshot(log.where("version <= 28"), True).persist()
    return arcs, traversal.bfs(arcs, spark.createDataFrame([(0,)], "v long")), log.where("version = 29")


@query(f"""with recursive {DIST}, lastop as (select src, dst, arg_max(op, seq) as op from batch where src <> dst group by all)
select l.src, l.dst from lastop l join arcs a on a.src = l.src and a.dst = l.dst join dist x on x.v = l.src join dist y on y.v = l.dst where not l.op and x.d + 1 = y.d""")
def affected_candidates(spark, sf):
    arcs, dist, batch = _before_batch(spark, sf)
    deleted = gr.canonical(batch, True).where("not add").join(arcs, ["src", "dst"], "left_semi")
    return deleted.join(dist.toDF("src", "_u"), "src").join(dist.toDF("dst", "_v"), "dst").where("_u + 1 = _v").select("src", "dst")


@query(f"""with recursive {DIST}, j as (select b.*, x.d as du, y.d as dv from batch b left join dist x on x.v = b.src left join dist y on y.v = b.dst)
select count(*) as updates, count_if(not op and du + 1 = dv) / count(*) as parent_deletions, count_if(not op and du + 1 = dv and dv <= 3) / count(*) as shallow_deletions,
count_if(op and du is not null and (dv is null or du + 1 < dv)) / count(*) as relaxable_insertions, count_if(op and du is not null and dv is null) / count(*) as new_targets, (count(du) + count(dv)) / (2 * count(*)) as reachable_ends from j""")
def structural_signals(spark, sf):
    _, dist, batch = _before_batch(spark, sf)
    return planner.structural_signals(batch, dist, True)


@query(f"with {LOG}, c as (select count(*) as n from ({fold('version <= 28')})) select version, count(*) / greatest(1, max(n)) as update_fraction from log, c where version > 28 group by version")
def update_fraction(spark, sf):
    log = user_log(spark, sf)
    n = max(1, gr.snapshot(log.where("version <= 28"), True).count())
    return log.where("version > 28").groupBy("version").agg((F.count(F.lit(1)) / F.lit(n)).alias("update_fraction"))


ESTIMATES = """e as (select range as id, range * 13 % 97 as changed_edges, (range % 9) * 100 as total_edges, range % 40 as affected_vertices, (range % 7) * 30 as total_vertices, (range % 5) * 0.7::double as frontier_growth,
 (range % 11) * 0.15::double as observed_fraction, (range % 6) * 0.5::double as speedup, (range % 4) * 0.4::double as success_rate from range(500))"""


@query(f"""with {ESTIMATES}, s as (select *, least(greatest(0.45::double * (case when total_edges = 0 then 0 else changed_edges / total_edges end) * greatest(1.0, frontier_growth)
 + 0.35::double * (case when total_vertices = 0 then 0 else affected_vertices / total_vertices end) + 0.2::double * least(greatest(observed_fraction, 0), 1), 0), 1.5) as st, (total_edges + total_vertices)::double as full_cost,
 greatest(0.1, speedup) as sp, least(greatest(success_rate, 0), 1) as su from e), c as (select *, full_cost * st * (2 - su) / sp as inc from s)
select id, round(st, 9) as structural, full_cost, round(inc, 6) as incremental_cost, round(least(greatest(0.5 * su + 0.3 * least(1, sp / 2) + 0.2 * (1 - least(1, st)), 0), 1), 9) as confidence, inc < 0.65 * full_cost and su >= 0.5 as incremental from c""")
def plan_cost(spark, sf):
    i = F.col("id")
    e = spark.range(500).select("id", (i * 13 % 97).alias("changed_edges"), (i % 9 * 100).alias("total_edges"), (i % 40).alias("affected_vertices"), (i % 7 * 30).alias("total_vertices"), (i % 5 * 0.7).alias("frontier_growth"), (i % 11 * 0.15).alias("observed_fraction"), (i % 6 * 0.5).alias("speedup"), (i % 4 * 0.4).alias("success_rate"))
    return planner.choose_columns(e).select("id", F.round("structural", 9).alias("structural"), "full_cost", F.round("incremental_cost", 6).alias("incremental_cost"), F.round("confidence", 9).alias("confidence"), "incremental")


@query("select range as id, range % 50 / 400 > 0.08 as dense, range % 50 / 400 > 0.08 or (range % 90) / 500 > 0.12 as pull from range(300)")
def push_pull(spark, sf):
    i = F.col("id")
    return spark.range(300).select("id", decisions.dense_frontier(i % 50, F.lit(400)).alias("dense"), decisions.pull(i % 50, F.lit(400), i % 90, F.lit(500)).alias("pull"))


@query(f"""with {ARCS}, d as (select src % 16 as frontier, count(*) as degree from arcs group by src), g as (select frontier, count(*) as vertices, sum(degree)::bigint as edges, count_if(degree >= 64) as hi from d group by frontier),
m as (select *, edges / vertices as average, case when edges / vertices >= 64 or hi / vertices >= 0.08 then 'edge_balanced' when edges / vertices >= 16 then 'hybrid' else 'vertex_balanced' end as mode from g)
select frontier, vertices, edges, average, mode, greatest(1, ceil((case when mode = 'vertex_balanced' then vertices else greatest(vertices, edges) end) / 32))::bigint as grain from m""")
def frontier_schedule(spark, sf):
    return decisions.frontier_schedule(gr.degrees(customer_arcs(spark, sf)).select((F.col("v") % 16).alias("frontier"), "degree"), 4, ["frontier"])


@query(f"""with {ARCS}, {PAIRS}, l as (select src, count(*) as n, max(dst) as last from arcs group by src)
select a, b, case when least(x.n, y.n) = 0 then 'merge' when x.n + y.n >= 1024 and greatest(x.last, y.last) <= (x.n + y.n) * 8 then 'bitmap' when greatest(x.n, y.n) > 16 * least(x.n, y.n) then 'galloping' when least(x.n, y.n) >= 32 then 'vector' else 'merge' end as method,
(select count(*) from arcs p join arcs q on p.dst = q.dst where p.src = a and q.src = b) as size from pairs join l x on x.src = a join l y on y.src = b""")
def kernel_choice(spark, sf):
    lists = gr.neighbor_lists(customer_arcs(spark, sf))
    both = probe_pairs(spark).join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b")
    return both.select("a", "b", decisions.intersection_method(F.size("x"), F.size("y"), F.array_max("x"), F.array_max("y")).alias("method"), decisions.intersection_size(F.col("x"), F.col("y")).cast("long").alias("size"))


SIGNALS = "g as (select range as id, range * 1000000 as arcs, range * 37 % 400 as storage, range % 5 * 80 as base_storage, range % 13 * 1.5::double as latency, range % 6 * 2.0::double as base_latency from range(240))"


@query(f"""with {SIGNALS}, r as (select *, case when base_storage = 0 then 1.0 else storage / base_storage end as storage_ratio, case when base_latency <= 0 then 1.0 else latency / base_latency end as latency_ratio from g)
select id, storage_ratio, latency_ratio, storage_ratio >= (case when arcs >= 100000000 then 1.5 else 1.25 end) as storage_exceeded, latency_ratio >= 1.25 as latency_exceeded,
storage_ratio >= (case when arcs >= 100000000 then 1.5 else 1.25 end) or latency_ratio >= 1.25 as consolidate from r""")
def consolidation_signal(spark, sf):
    i = F.col("id")
    g = spark.range(240).select("id", (i * 1000000).alias("arcs"), (i * 37 % 400).alias("storage"), (i % 5 * 80).alias("base_storage"), (i % 13 * 1.5).alias("latency"), (i % 6 * 2.0).alias("base_latency"))
    return consolidation.evaluate_columns(g).select("id", "storage_ratio", "latency_ratio", "storage_exceeded", "latency_exceeded", "consolidate")


@query("""with c as (select range as id, range * 7 % 100 as n, range % 12 as parts from range(60)), p as (select *, greatest(1, least(parts, n)) as k from c)
select id, n, parts, part, n * part // k as "begin", n * (part + 1) // k as "end" from (select *, unnest(range(k)) as part from p)""")
def partition_ranges(spark, sf):
    i = F.col("id")
    return decisions.partition_ranges(spark.range(60).select("id", (i * 7 % 100).alias("n"), (i % 12).alias("parts")), "n", "parts").withColumn("part", F.col("part").cast("long"))


# Codecs.


SIZES = """b as (select src, dst, row_number() over w as k, dst - lag(dst, 1, 0) over w as d from arcs window w as (partition by src order by dst)),
pb as (select src, (k - 1) // 128 as blk, count(*) as n, sum(1 + (d >= 128)::int + (d >= 16384)::int + (d >= 2097152)::int + (d >= 268435456)::int) as vb, max(case when (k - 1) % 128 = 0 then dst else d end) as m from b group by all),
z as (select src as v, sum(n)::bigint as n, sum(vb)::bigint as varbyte_bytes, sum(n * case when m < 256 then 1 when m < 65536 then 2 else 4 end)::bigint as fixed_bytes from pb group by src)"""


@query(f"with {ARCS}, {SIZES} select * from z")
def codec_sizes(spark, sf):
    return codec.sizes(customer_arcs(spark, sf)).select("v", *(F.col(c).cast("long").alias(c) for c in ("n", "varbyte_bytes", "fixed_bytes")))


@query(f"with {ARCS}, {SIZES} select v, case when fixed_bytes < varbyte_bytes or fixed_bytes <= 1.1 * varbyte_bytes then 'fixed' else 'varbyte' end as codec from z")
def codec_choice(spark, sf):
    return codec.choice(codec.sizes(customer_arcs(spark, sf))).select("v", "codec")


@query(f"with {ARCS}, {SIZES} select v, varbyte_bytes, fixed_bytes from z")
def codec_bytes(spark, sf):
    """The sizes again, but of bytes really encoded."""
    coded = codec.encode_lists(gr.neighbor_lists(customer_arcs(spark, sf)))
    return coded.select("v", F.octet_length("varbyte").cast("long").alias("varbyte_bytes"), F.octet_length("fixed").cast("long").alias("fixed_bytes"))


@query("""with m as (select l_partkey % 20 as family, case when l_linenumber % 2 = 0 then 'fixed' else 'varbyte' end as codec, sum(l_suppkey + 1)::double as encoded_bytes, sum(l_quantity) as decode_us from lineitem group by all),
j as (select f.encoded_bytes / v.encoded_bytes as o, f.decode_us < v.decode_us as wins from m f join m v on f.family = v.family and f.codec = 'fixed' and v.codec = 'varbyte')
select median(case when wins then o end) as overhead, count_if(wins) as families from j""")
def codec_calibration(spark, sf):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "fixed").otherwise("varbyte")
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 20).alias("family"), kind.alias("codec")).agg(F.sum(F.col("l_suppkey") + 1).cast("double").alias("encoded_bytes"), F.sum("l_quantity").alias("decode_us"))
    return codec.calibrate(rows)


# Streams.


EDGES = f"{LOG}, ed as (select src, dst from log)"


@query(f"""with {EDGES}, ids as (select id, row_number() over (order by id) - 1 as n from (select src as id from ed union select dst from ed))
select distinct least(x.n, y.n) as src, greatest(x.n, y.n) as dst from ed join ids x on x.id = src join ids y on y.id = dst where src <> dst""")
def edge_relabel(spark, sf):
    return streams.normalize(user_log(spark, sf))


@query(f"""with {EDGES}, p as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from ed where src <> dst group by all)
select (select count(*) from ed) as rows, (select count(*) from (select src from ed union select dst from ed)) as vertices, (select count(*) from ed where src = dst) as loops, sum(n - 1)::bigint as duplicates, count(*) as edges from p""")
def dataset_inspection(spark, sf):
    return streams.normalize_counts(user_log(spark, sf).select("src", "dst"))


@query(f"with {CUST} select least(src, dst) as a, greatest(src, dst) as b, count(*) as n, count_if(src < dst) as forward, min(pos) as first_pos from st group by all")
def symmetric_stream_check(spark, sf):
    return streams.symmetric_check(customer_stream(spark, sf))


@query(f"""with {LOG}, n as (select *, lead(src) over w as ns, lead(dst) over w as nd, lead(us) over w as nu from log window w as (order by version, seq))
select count(*) as events, count_if(src = dst) as loops, count_if(src = ns and dst = nd and us = nu) as repeats, count_if(nu < us) as backward from n""")
def temporal_order_check(spark, sf):
    return streams.temporal_check(user_log(spark, sf), "version", ["seq"])


@query(f"""with {CUST} select pos, src, dst from (select pos, src, dst, row_number() over (partition by least(src, dst), greatest(src, dst) order by pos) as rn from st where src <> dst) where rn = 1""")
def first_occurrence_dedupe(spark, sf):
    return streams.first_occurrences(customer_stream(spark, sf))


@query(f"""with {CUST} select s.pos * 2 + k as pos, k, case when k = 0 then src else dst end as src, case when k = 0 then dst else src end as dst from st s, (select unnest([0, 1]) as k) where src <> dst""")
def dynamic_stream(spark, sf):
    got = streams.dynamic_stream(customer_stream(spark, sf), True, True)
    return got.select((F.col("pos") * 2 + F.col("k")).alias("pos"), "k", "src", "dst")


WINDOW = "wb as (select (pos - 8000) // 500 as batch, pos as seq, src, dst, true as is_add from st where pos >= 8000 union all select pos // 500, pos + (select max(pos) from st) + 1, src, dst, false from st where pos <= (select max(pos) from st) - 8000)"


@query(f"with {CUST}, {WINDOW} select * from wb")
def window_batches(spark, sf):
    return streams.window_batches(customer_stream(spark, sf), 8000, 500).withColumnRenamed("add", "is_add")


@query(f"""with {LOG}, o as (select *, lag(op, 1, false) over (partition by src, dst order by version, seq) as p from log)
select count(*) as ops, count_if(op and p) as duplicate_adds, count_if(not op and not p) as absent_removes, (select count(*) from (select src from log union select dst from log)) as touched from o""")
def stream_validity(spark, sf):
    return streams.stream_validity(user_log(spark, sf).withColumn("pos", F.struct("version", "seq")))


@query(f"with {ARCS} select src as v, count(*) as degree from arcs group by src order by degree desc, v limit 3")
def root_by_degree(spark, sf):
    return streams.top_roots(customer_arcs(spark, sf), customers(spark, sf))


ROOTS = f"{CUST}, x as (select src as v, count(*) as a from st where pos < 8000 group by src), y as (select src as v, count(*) as b from st where pos >= 5000 group by src)"


@query(f"with {ROOTS} select v, least(a, b) as low, a + b as total from x join y using (v) order by low desc, total desc, v limit 1")
def bfs_root(spark, sf):
    s = customer_stream(spark, sf)
    return streams.window_roots(s.where("pos < 8000"), s.where("pos >= 5000"))


@query(f"with {ROOTS} select v, least(a, b) as low, a + b as total from x join y using (v) order by low desc, total desc, v limit 5")
def dynamic_roots_topk(spark, sf):
    s = customer_stream(spark, sf)
    return streams.window_roots(s.where("pos < 8000"), s.where("pos >= 5000"), 5)


@query(f"with {CUST} select src, dst, sha256('7:' || src || ':' || dst) as key from (select distinct src, dst from st) order by key limit 200")
def bottom_k_sample(spark, sf):
    return streams.bottom_k(customer_stream(spark, sf), 7, 200)


@query(f"""with {CUST}, o as (select pos, src, dst from (select pos, src, dst, row_number() over (partition by least(src, dst), greatest(src, dst) order by pos) as rn from st where src <> dst) where rn = 1),
r as (select *, row_number() over (order by sha256('11:' || pos || ':' || src || ':' || dst)) as k, count(*) over () as n from o)
select pos, src, dst, k <= round_even(n * 0.9, 0) as initial from r""")
def seeded_split(spark, sf):
    first, rest = streams.seeded_split(streams.first_occurrences(customer_stream(spark, sf)), 11, 0.9)
    return first.withColumn("initial", F.lit(True)).unionByName(rest.withColumn("initial", F.lit(False)))


@query(f"""with {CUST}, o as (select pos, src, dst from (select pos, src, dst, row_number() over (partition by least(src, dst), greatest(src, dst) order by pos) as rn from st where src <> dst) where rn = 1)
select pos * 2 + k as pos, case when k = 0 then 'a' else 'd' end as op, src, dst from o, (select unnest([0, 1]) as k)""")
def mutation_stream(spark, sf):
    return streams.mutation_stream(streams.first_occurrences(customer_stream(spark, sf)))


# Generators.


@query("select range as src, (range + s) % 500 as dst from range(500), (select unnest([1, 7, 31]) as s)")
def circulant_graph(spark, sf):
    return generators.circulant(spark, 500)


@query("with t as (select range * 6 as t from range(40)), k as (select range + 1 as k from range(5)) select t as src, t + k as dst from t, k union all select t + k, t + 6 from t, k")
def layered_diamonds(spark, sf):
    return generators.layered_diamonds(spark, 40, 5)


# Reports, over a trace made from the events.


TRACE = """t as (select event_type as dataset, event_id % 4 as batch_size, case when event_id % 2 = 0 then 'adaptive' else 'simple_threshold' end as policy, 1 + value as batch_us, 1 + value * (0.5 + (event_id % 7) / 14) as oracle_batch_us,
 user_id % 3 = 0 as explicit_full, event_id % 3 = 0 as oracle_full, event_id % 11 = 0 as internal_fallback from events)"""
REGRET = f"""{TRACE}, q as (select *, greatest(0, (batch_us - oracle_batch_us) / oracle_batch_us) as r from t),
g as (select dataset, batch_size, policy, count(*) as samples, avg(r) as mean_regret, quantile_cont(r, 0.5) as median_regret, quantile_cont(r, 0.95) as p95_regret, quantile_cont(r, 0.99) as p99_regret, max(r) as max_regret,
 avg((explicit_full <> oracle_full)::int) as wrong_arm_rate, avg(explicit_full::int) as full_choice_fraction, avg(internal_fallback::int) as internal_fallback_fraction from q group by all)"""


def trace(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.col("event_type").alias("dataset"), (e % 4).alias("batch_size"), F.when(e % 2 == 0, "adaptive").otherwise("simple_threshold").alias("policy"), (1 + F.col("value")).alias("batch_us"), (1 + F.col("value") * (0.5 + (e % 7) / 14)).alias("oracle_batch_us"), (F.col("user_id") % 3 == 0).alias("explicit_full"), (e % 3 == 0).alias("oracle_full"), (e % 11 == 0).alias("internal_fallback"))


def rounded(df: DataFrame, keep: set[str]) -> DataFrame:
    return df.select(*(c if c in keep else F.round(c, 9).alias(c) for c in df.columns))


@query(f"with {REGRET} select dataset, batch_size, policy, samples, {', '.join(f'round({c}, 9) as {c}' for c in ('mean_regret', 'median_regret', 'p95_regret', 'p99_regret', 'max_regret', 'wrong_arm_rate', 'full_choice_fraction', 'internal_fallback_fraction'))} from g")
def regret_summary(spark, sf):
    return rounded(reports.regret_summary(trace(spark, sf)), {"dataset", "batch_size", "policy", "samples"})


@query(f"with {REGRET} select policy, count(*) as regimes, round(avg(mean_regret), 9) as equal_regime_mean, round(max(mean_regret), 9) as worst_mean, round(max(p95_regret), 9) as worst_p95, round(max(max_regret), 9) as max_regret from g group by policy")
def regret_rollup(spark, sf):
    return rounded(reports.regret_rollup(reports.regret_summary(trace(spark, sf))), {"policy", "regimes"})


CROSS = """m as (select 'd' || (l_suppkey % 3) as dataset, 'a' || (l_linenumber % 2) as algorithm, (l_partkey % 8) / 100 as update_fraction, (l_orderkey % 1000 + 1)::double as incremental_ns, (l_orderkey % 700 + 200 - (l_partkey % 8) * 90)::double as full_recompute_ns, l_orderkey % 997 <> 0 as correct from lineitem),
c as (select dataset, algorithm, update_fraction, count(*) as runs, median(incremental_ns) as incremental_median_ns, median(full_recompute_ns) as full_median_ns, quantile_disc(incremental_ns, 0.95) as incremental_p95_ns, quantile_disc(full_recompute_ns, 0.95) as full_p95_ns, median(full_recompute_ns / incremental_ns) as median_speedup, bool_and(correct) as all_correct from m group by all)"""


def measurements(spark, sf) -> DataFrame:
    part = F.col("l_partkey") % 8
    m = table(spark, sf, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("dataset"), F.concat(F.lit("a"), (F.col("l_linenumber") % 2).cast("string")).alias("algorithm"), (part / 100).alias("update_fraction"), (F.col("l_orderkey") % 1000 + 1).cast("double").alias("incremental_ns"), (F.col("l_orderkey") % 700 + 200 - part * 90).cast("double").alias("full_recompute_ns"), (F.col("l_orderkey") % 997 != 0).alias("correct"))
    return m.withColumn("speedup", F.col("full_recompute_ns") / F.col("incremental_ns"))


@query(f"with {CROSS} select dataset, algorithm, update_fraction, runs, incremental_median_ns, full_median_ns, incremental_p95_ns, full_p95_ns, round(median_speedup, 9) as median_speedup, all_correct from c")
def update_crossover(spark, sf):
    return reports.crossover(measurements(spark, sf)).withColumn("median_speedup", F.round("median_speedup", 9))


@query(f"with {CROSS} select dataset, algorithm, min(case when median_speedup <= 1 then update_fraction end) as crossover_fraction from c group by all")
def first_crossover(spark, sf):
    return reports.first_crossover(reports.crossover(measurements(spark, sf)))


MODES = "f as (select event_id // 3 as batch, case event_id % 3 when 0 then 'fallback_only' when 1 then 'selector_plus_fallback' else 'always_full' end as mode, value as batch_us, user_id % 5 = 0 as explicit_full, user_id % 7 = 0 as internal_fallback, value / 2 as wasted_us from events)"


def modes(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.floor(e / 3).alias("batch"), F.when(e % 3 == 0, "fallback_only").when(e % 3 == 1, "selector_plus_fallback").otherwise("always_full").alias("mode"), F.col("value").alias("batch_us"), (F.col("user_id") % 5 == 0).alias("explicit_full"), (F.col("user_id") % 7 == 0).alias("internal_fallback"), (F.col("value") / 2).alias("wasted_us"))


@query(f"with {MODES} select mode, count(*) as batches, count_if(internal_fallback) as fallbacks, count_if(explicit_full) as explicit_full, round(sum(case when internal_fallback then wasted_us else 0 end), 4) as double_work_us, round(sum(batch_us), 4) as total_us from f group by mode")
def fallback_accounting(spark, sf):
    return reports.fallback_accounting(modes(spark, sf)).withColumns({c: F.round(c, 4) for c in ("double_work_us", "total_us")})


@query(f"with {MODES}, j as (select a.internal_fallback as fell, a.wasted_us as waste, b.explicit_full as ex from f a join f b on a.batch = b.batch and a.mode = 'fallback_only' and b.mode = 'selector_plus_fallback') select count_if(fell) as fallbacks, count_if(fell and ex) as avoided, round(sum(case when fell and ex then waste else 0 end), 4) as avoided_us from j")
def avoided_fallbacks(spark, sf):
    return reports.avoided_fallbacks(modes(spark, sf)).withColumn("avoided_us", F.round("avoided_us", 4))


@query("select d as dataset, f as fraction, r as repetition from (select unnest(['x', 'y', 'z']) as d), (select unnest([0.001, 0.01, 0.1]::double[]) as f), (select unnest([1, 2, 3, 4, 5]) as r)")
def experiment_matrix(spark, sf):
    return reports.experiment_matrix(spark, {"dataset": ["x", "y", "z"], "fraction": [0.001, 0.01, 0.1], "repetition": [1, 2, 3, 4, 5]})


@query("with p as (select l_linenumber % 5 as metric, median(case when l_orderkey % 2 = 0 then l_quantity end) as base, median(case when l_orderkey % 2 = 1 then l_quantity end) as other from lineitem group by all) select 'm' || metric as metric, base, other, other / nullif(base, 0) as ratio from p")
def variant_ratios(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), (F.col("l_linenumber") % 5).cast("string")).alias("metric"), F.when(F.col("l_orderkey") % 2 == 0, "base").otherwise("other").alias("variant"), F.col("l_quantity").alias("value"))
    return reports.variant_ratios(rows, "base", "other")


@query()
def planner_replay(spark, sf):
    """Every preset over one recorded trace of twelve batches."""
    recorded = [{"batch": k, "update_fraction": 0.002 * (k % 5 + 1), "updates": 10 * (k % 5 + 1), "incremental_us": 40.0 * (k % 5 + 1) + (900 if k == 7 else 0), "full_us": 150.0, "affected": k % 3} for k in range(12)]
    rows = [r for name in planner.PRESETS for r in planner.replay(name, recorded, 5_000, 150.0, 0.6)]
    return spark.createDataFrame([(r["policy"], r["batch"], r["full"], r["reason"], float(r["cost"]), r["oracle_full"], float(r["regret"])) for r in rows], "policy string, batch long, explicit_full boolean, reason string, cost_us double, oracle_full boolean, regret double")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A maintained search over the user log."""
    return bfs_incremental(spark, sf)


# The same questions over the whole tables: every order probes, and every adjacent pair is compared.


@query(f"""with {ARCS}, probe as (select o_custkey as src, o_orderkey % (select count(*) from customer) as dst from orders)
select distinct src, dst, exists (select 1 from arcs a where a.src = p.src and a.dst = p.dst) as present from probe p""")
def has_edge_whole(spark, sf):
    n = customers(spark, sf)
    probe = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst")).distinct()
    return probe.join(customer_arcs(spark, sf).withColumn("present", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("present", F.lit(False)).alias("present"))


ADJACENT = "pairs as (select src as a, dst as b from arcs where src < dst)"


def adjacent_pairs(arcs: DataFrame) -> DataFrame:
    return arcs.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query(f"with {ARCS}, {ADJACENT}, {COMMON} select * from com")
def common_neighbors_whole(spark, sf):
    return similarity.adjacent_common(fixpoint.cut(customer_arcs(spark, sf)))


@query(_sql["jaccard"].replace(PAIRS, ADJACENT))
def jaccard_whole(spark, sf):
    arcs = fixpoint.cut(customer_arcs(spark, sf))
    return similarity.with_jaccard(arcs, similarity.adjacent_common(arcs))


@query(_sql["kernel_choice"].replace(PAIRS, ADJACENT))
def kernel_choice_whole(spark, sf):
    arcs = customer_arcs(spark, sf)
    lists = gr.neighbor_lists(arcs)
    both = adjacent_pairs(arcs).join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b")
    return both.select("a", "b", decisions.intersection_method(F.size("x"), F.size("y"), F.array_max("x"), F.array_max("y")).alias("method"), decisions.intersection_size(F.col("x"), F.col("y")).cast("long").alias("size"))


@query(_sql["components"].replace(SPARSE, ARCS))
def components_whole(spark, sf):
    return cc.connected_components(customer_arcs(spark, sf), schema.vertices(spark, customers(spark, sf)))


@query(_sql["component_sizes"].replace(SPARSE, ARCS))
def component_sizes_whole(spark, sf):
    return cc.sizes(cc.min_labels(customer_arcs(spark, sf), schema.vertices(spark, customers(spark, sf))))


@query(_sql["reachable"].replace(SPARSE, ARCS))
def reachable_whole(spark, sf):
    arcs, n = customer_arcs(spark, sf).persist(), customers(spark, sf)
    return traversal.reach(traversal.bfs_distances(arcs, n, arcs.agg(F.min("src")).first()[0]), n)


@query(_sql["pagerank_dangling"].replace(SPARSE, ARCS))
def pagerank_dangling_whole(spark, sf):
    return pagerank.fixed_rounds(customer_arcs(spark, sf), customers(spark, sf), 12).select("v", F.round("rank", 8).alias("rank"))


@query(_sql["dangling_count"].replace(SPARSE, ARCS))
def dangling_count_whole(spark, sf):
    n = customers(spark, sf)
    return customer_arcs(spark, sf).agg((F.lit(n) - F.count_distinct("src")).alias("dangling"))


from . import catalog_more  # noqa: E402, F401  more queries, registered as they are read
