"""Preparing edge streams (pos, src, dst[, ts]): relabelling, checks, samples, batches and roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..plans import fixpoint
from .components import dense_numbers
from .graph import degrees


def ordered_lead(df: DataFrame, bucket: str, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the row that follows in (bucket, order).

    Rows are ordered within their bucket, and only the first row of each bucket is carried across, so no task sees all rows.
    """
    w = Window.partitionBy(bucket).orderBy(*order)
    first = F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("_f")
    across = df.groupBy(bucket).agg(first).select(bucket, F.lead("_f").over(Window.orderBy(bucket)).alias("_f"))
    got = df.withColumns({f"_n_{c}": F.lead(c).over(w) for c in columns} | {"_last": F.lead(F.lit(1)).over(w).isNull()}).join(across, bucket)
    return got.withColumns({f"next_{c}": F.when(F.col("_last"), F.col(f"_f.{c}")).otherwise(F.col(f"_n_{c}")) for c in columns}).drop("_last", "_f", *(f"_n_{c}" for c in columns))


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with dense ids in ascending order of the originals, the map (id, number)); loop endpoints count as vertices."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    numbers = dense_numbers(ids, "id")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a, b = numbers.toDF("src", "_a"), numbers.toDF("dst", "_b")
    return edges.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), *rest), numbers


def normalize(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Relabelled, loop-free, canonical and distinct edges."""
    a, b = schema.pair_key(directed)
    return relabel(edges)[0].where("src <> dst").select(a.alias("src"), b.alias("dst")).distinct()


def normalize_counts(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row: rows, vertices, loops, duplicates (rows beyond the first of an edge), edges."""
    a, b = schema.pair_key(directed)
    kept = edges.where("src <> dst").select(a.alias("a"), b.alias("b"))
    counts = kept.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.count_distinct("id").alias("vertices"))
    base = edges.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    return base.join(F.broadcast(counts), how="full", on=F.lit(True)).join(F.broadcast(ids), how="full", on=F.lit(True)).select("rows", "vertices", "loops", "duplicates", "edges")


def temporal_check(stream: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """One row: events, loops, consecutive duplicates and steps back in time of a stream (src, dst, ts)."""
    rows = ordered_lead(stream, bucket, order, ["src", "dst", "ts"])
    return rows.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("src") == F.col("dst")).alias("loops"),
        F.count_if((F.col("src") == F.col("next_src")) & (F.col("dst") == F.col("next_dst")) & (F.col("ts") == F.col("next_ts"))).alias("repeats"),
        F.count_if(F.col("next_ts") < F.col("ts")).alias("backward"),
    )


def pinned(stream: DataFrame, edges: int | None = None, vertices: int | None = None) -> DataFrame:
    """Relabelled stream in its order; loops and counts other than expected are errors."""
    if not stream.where("src = dst").isEmpty():
        raise ValueError("the stream has a loop")
    out, numbers = relabel(stream)
    for name, want, df in (("edges", edges, stream), ("vertices", vertices, numbers)):
        if want is not None and (found := df.count()) != want:
            raise ValueError(f"{found} {name}, not {want}")
    return out


def symmetric_check(stream: DataFrame) -> DataFrame:
    """(a, b, n, forward, first_pos) of each unordered pair: rows, rows from the smaller end, first position."""
    return stream.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") < F.col("dst")).alias("forward"), F.min("pos").alias("first_pos"))


def symmetric_stream(stream: DataFrame, multiplicity: int = 2) -> DataFrame:
    """(pos, k, src, dst): both arcs of each pair, one after the other, in order of first appearance; each pair must occur as often as said, in both orientations equally."""
    pairs = symmetric_check(stream)
    if not pairs.where((F.col("n") != multiplicity) | (F.col("forward") * 2 != F.col("n")) | (F.col("a") == F.col("b"))).isEmpty():
        raise ValueError("the stream is not symmetric")
    arcs = F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.lit(1).alias("k"), F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.col("first_pos").alias("pos"), F.explode(arcs).alias("e")).select("pos", "e.*")


def dynamic_stream(stream: DataFrame, symmetrize: bool = False, drop_loops: bool = False) -> DataFrame:
    """(pos, k, src, dst) with ids checked, both arcs of each edge and loops dropped if asked for."""
    rows = stream.select("pos", schema.checked_id(F.col("src")).alias("src"), schema.checked_id(F.col("dst")).alias("dst"))
    rows = rows.where("src <> dst") if drop_loops else rows
    arcs = [F.struct(F.lit(0).alias("k"), "src", "dst")] + [F.struct(F.lit(1).alias("k"), F.col("dst").alias("src"), F.col("src").alias("dst"))] * symmetrize
    return rows.select("pos", F.explode(F.array(*arcs)).alias("e")).select("pos", "e.*")


def external_stream(stream: DataFrame) -> DataFrame:
    """The stream as it is, if its ids are 0 to N - 1 without a gap."""
    row = stream.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count_distinct("id").alias("n")).first()
    if row.n and (row.low != 0 or row.top != row.n - 1):
        raise ValueError("ids are not dense")
    return stream


def window_batches(stream: DataFrame, initial: int, batch: int) -> DataFrame:
    """(batch, seq, src, dst, add): each batch adds the next positions, from 0, and then removes as many of the oldest.

    Position p >= initial is added in batch (p - initial) div batch, and p - initial, its predecessor by the window, is removed there.
    """
    last = stream.agg(F.max("pos")).first()[0]
    last = -1 if last is None else last
    added = stream.where(F.col("pos") >= initial).select(F.floor((F.col("pos") - initial) / batch).cast("long").alias("batch"), F.col("pos").alias("seq"), "src", "dst", F.lit(True).alias("add"))
    removed = stream.where(F.col("pos") <= last - initial).select(F.floor(F.col("pos") / batch).cast("long").alias("batch"), (F.col("pos") + last + 1).alias("seq"), "src", "dst", F.lit(False).alias("add"))
    return added.unionByName(removed)


def first_occurrences(stream: DataFrame) -> DataFrame:
    """(pos, src, dst): the first row of each unordered pair, loops dropped."""
    rows = stream.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("pos", "src", "dst")).alias("f"))
    return rows.select("f.pos", "f.src", "f.dst")


def kth_key(keyed: DataFrame, key: str, k: int, digits: int = 4) -> str | None:
    """The k-th smallest of distinct hex digests, None if k < 1: digests are counted by their first digits, and only those of one such bucket are ordered."""
    start = F.substring(key, 1, digits)
    for bucket, n in sorted(keyed.groupBy(start.alias("b")).count().collect()):  # 65,536 rows at most
        if 0 < k <= n:
            return keyed.where(start == bucket).select(key).orderBy(key).limit(k).agg(F.max(key)).first()[0]
        k -= n
    return None


def seeded_split(edges: DataFrame, seed: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(initial, rest) of edges (pos, src, dst) in the order of sha256(seed:pos:src:dst); duplicates are errors.  The share is rounded half to even."""
    edges = fixpoint.cut(edges)
    if not edges.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("a directed edge occurs twice")
    k = round(edges.count() * share)
    keyed = edges.withColumn("_k", F.sha2(F.concat_ws(":", F.lit(str(seed)), "pos", "src", "dst"), 256))
    last = kth_key(keyed, "_k", k) or ""
    return keyed.where(F.col("_k") <= last).drop("_k"), keyed.where(F.col("_k") > last).drop("_k")


def mutation_stream(rest: DataFrame) -> DataFrame:
    """(pos, op, src, dst): each edge inserted and, right after, deleted."""
    ops = F.array(F.struct(F.lit(0).alias("k"), F.lit("a").alias("op")), F.struct(F.lit(1).alias("k"), F.lit("d").alias("op")))
    return rest.select("pos", "src", "dst", F.explode(ops).alias("e")).select((F.col("pos") * 2 + F.col("e.k")).alias("pos"), "e.op", "src", "dst")


def bottom_k(edges: DataFrame, seed: int, k: int) -> DataFrame:
    """The k distinct edges of smallest sha256(seed:src:dst), a sample that doesn't depend on order; hex digests order as the numbers do."""
    keyed = edges.select("src", "dst").distinct().withColumn("key", F.sha2(F.concat_ws(":", F.lit(str(seed)), "src", "dst"), 256))
    return keyed.orderBy("key").limit(k)


def top_roots(arcs: DataFrame, n: int, k: int = 3) -> DataFrame:
    """(v, degree) of the k vertices of largest out-degree, ties and padding by smallest id."""
    first = schema.vertices(arcs.sparkSession, min(n, k))
    # Degrees of vertices with arcs, and the smallest ids for padding.
    both = degrees(arcs).unionByName(first.select("v", F.lit(0).cast("long").alias("degree"))).groupBy("v").agg(F.max("degree").alias("degree"))
    return both.orderBy(F.col("degree").desc(), "v").limit(k)


def window_roots(before: DataFrame, after: DataFrame, k: int = 1) -> DataFrame:
    """(v, low, total): vertices with arcs in both windows, by the smaller of their degrees, then the sum, then the id."""
    a, b = degrees(before).toDF("v", "_a"), degrees(after).toDF("v", "_b")
    both = a.join(b, "v").select("v", F.least("_a", "_b").alias("low"), (F.col("_a") + F.col("_b")).alias("total"))
    return both.orderBy(F.col("low").desc(), F.col("total").desc(), "v").limit(k)


def aligned_shift(initial: int, total: int, batch: int) -> int:
    """How far the window moves by whole batches until the stream ends."""
    return (total - initial) // batch * batch


def stream_validity(ops: DataFrame) -> DataFrame:
    """One row: operations, duplicate additions, removals of absent edges, touched vertices of a stream (pos, src, dst, add) onto an empty graph."""
    before = F.lag("add", 1, False).over(Window.partitionBy("src", "dst").orderBy("pos"))
    rows = ops.withColumn("_p", before)
    flat = rows.agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("add") & F.col("_p")).alias("duplicate_adds"), F.count_if(~F.col("add") & ~F.col("_p")).alias("absent_removes"))
    touched = ops.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("touched"))
    return flat.join(F.broadcast(touched), how="full", on=F.lit(True))


def missing_edges(n: int, existing: set[tuple[int, int]], count: int, seed: int = 1) -> list[tuple[int, int]]:
    """New undirected edges drawn by a linear congruential generator; those that exist are passed over.  For driver-side experiments."""
    state, out, seen = seed & (1 << 64) - 1, [], set(existing)
    if len(existing) + count > n * (n - 1) // 2:
        raise ValueError("the graph has not that many missing edges")
    while len(out) < count:
        pair = []
        for _ in range(2):
            state = (state * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
            pair.append((state >> 33) % n)
        e = min(pair), max(pair)
        if e[0] != e[1] and e not in seen:
            seen.add(e)
            out.append(e)
    return out


def row_replacements(arcs: DataFrame, n: int, rows: int, round_number: int) -> DataFrame:
    """(src, dst, add): for ``rows`` vertices of this round, the smallest neighbour is replaced by the first larger id that is none, so operations never conflict."""
    chosen = degrees(arcs).withColumn("_k", F.xxhash64(F.lit(round_number), "v")).orderBy("_k").limit(rows).select(F.col("v").alias("src"))
    lists = arcs.join(F.broadcast(chosen), "src").groupBy("src").agg(F.min("dst").alias("old"), F.collect_set("dst").alias("all"))
    candidates = F.filter(F.transform(F.sequence(F.lit(1), F.size("all") + 2), lambda k: (F.col("old") + k) % n), lambda c: ~F.array_contains(F.col("all"), c) & (c != F.col("src")))
    return lists.where(F.size(candidates) > 0).select("src", F.explode(F.array(F.struct(F.col("old").alias("dst"), F.lit(False).alias("add")), F.struct(candidates[0].alias("dst"), F.lit(True).alias("add")))).alias("e")).select("src", "e.*")
