"""Breadth-first search and shortest paths by frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans import blocks, fixpoint

#: Rounds after which the frontiers found so far are written as one table.
TOGETHER = 8


def bfs(arcs: DataFrame, sources: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(*key, v, d): hop distances of reached vertices from ``sources`` (*key, v).

    With a key, such as the source itself, many searches run in the same rounds.  A round joins the arcs with the last
    frontier, broadcast while small, and drops what has been seen.
    """
    names = [*key, "v"]
    dist = frontier = fixpoint.cut(sources.select(*names).distinct().withColumn("d", F.lit(0).cast("long")))
    size, rounds = frontier.count(), 0
    while size:
        rounds += 1
        ahead = arcs.join(fixpoint.sized(frontier, size).withColumnRenamed("v", "src"), "src").select(*key, F.col("dst").alias("v"), (F.col("d") + 1).alias("d")).distinct()
        frontier = fixpoint.cut(ahead.join(dist.select(*names), names, "left_anti"))
        size = frontier.count()
        if size:
            dist = dist.unionByName(frontier)
        if rounds % TOGETHER == 0:  # else plan and scans grow with the depth
            dist = fixpoint.cut(dist.coalesce(max(1, dist.rdd.getNumPartitions() // TOGETHER)))
    return fixpoint.cut(dist)


def bfs_distances(arcs: DataFrame, n: int, source: int) -> DataFrame:
    """(v, d) for all vertices; ``UNREACHABLE`` where no path leads.  A source out of range is an error."""
    if not 0 <= source < n:
        raise IndexError(f"no vertex {source}")
    spark = arcs.sparkSession
    found = bfs(arcs, spark.createDataFrame([(source,)], "v long"))
    return with_sentinel(schema.vertices(spark, n), found, schema.UNREACHABLE)


def with_sentinel(vertices: DataFrame, dist: DataFrame, sentinel: int) -> DataFrame:
    return vertices.join(dist, "v", "left").select("v", F.coalesce("d", F.lit(sentinel)).cast("long").alias("d"))


def layers(dist: DataFrame) -> DataFrame:
    """(d, n): vertices by distance, without unreachable ones."""
    return dist.where(F.col("d") < schema.UNREACHABLE).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def reach(dist: DataFrame, n: int) -> DataFrame:
    """(reached, fraction) of n vertices."""
    return dist.agg(F.count_if(F.col("d") < schema.UNREACHABLE).alias("reached")).select("reached", (F.col("reached") / F.lit(max(1, n))).alias("fraction"))


def shortest_paths(arcs: DataFrame, source: int, weighted: bool = True) -> DataFrame:
    """(v, d) of reached vertices; ``arcs`` (src, dst, w), or w = 1 throughout.  Distances at or above ``INFINITY`` count as unreachable."""
    spark = arcs.sparkSession
    arcs = arcs if weighted else arcs.select("src", "dst", F.lit(1).cast("long").alias("w"))
    start = spark.createDataFrame([(source, 0)], "v long, d long")
    return blocks.relax(start, start, arcs, schema.INFINITY - 1)


def sssp_distances(arcs: DataFrame, n: int, source: int, weighted: bool = True) -> DataFrame:
    if not 0 <= source < n:
        raise IndexError(f"no vertex {source}")
    return with_sentinel(schema.vertices(arcs.sparkSession, n), shortest_paths(arcs, source, weighted), schema.INFINITY)


def bfs_encoded(lists: DataFrame, source: int, column: str = "varbyte") -> DataFrame:
    """(v, d): hop distances over encoded neighbour lists (v, ``column``); only the frontier's lists are decoded, in Arrow batches."""
    import pyarrow as pa

    from ..functions import codec

    def decoded(batches):
        for batch in batches:
            parts = [codec.undeltas(codec.varbyte_decode(raw)) for raw in batch.column(0).to_pylist()]
            for part in parts:
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64())], names=["v"])

    spark, depth = lists.sparkSession, 0
    dist = frontier = fixpoint.cut(spark.createDataFrame([(source, 0)], "v long, d long"))
    while size := frontier.count():
        depth += 1
        ahead = lists.join(fixpoint.sized(frontier.select("v"), size), "v").select(column).mapInArrow(decoded, "v long").distinct()
        frontier = fixpoint.cut(ahead.join(dist, "v", "left_anti").withColumn("d", F.lit(depth).cast("long")))
        dist = fixpoint.cut(dist.unionByName(frontier))
    return dist
