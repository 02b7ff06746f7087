"""Small choices as column expressions: traversal direction, schedules, intersection methods, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_frontier(frontier: Column, n: Column) -> Column:
    return frontier / F.greatest(F.lit(1), n) > 0.08


def pull(frontier: Column, n: Column, frontier_edges: Column, m: Column) -> Column:
    """Whether to pull: the frontier holds more than 8 % of vertices or 12 % of edges."""
    return dense_frontier(frontier, n) | (frontier_edges / F.greatest(F.lit(1), m) > 0.12)


def frontier_schedule(degrees: DataFrame, workers: int, key: list[str] = (), dense: float = 0.08, high: int = 64) -> DataFrame:
    """(*key, vertices, edges, average, mode, grain) of frontiers given as rows (*key, degree)."""
    got = degrees.groupBy(*key).agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").cast("long").alias("edges"), F.count_if(F.col("degree") >= high).alias("_high"))
    average = F.col("edges") / F.col("vertices")
    mode = F.when((average >= high) | (F.col("_high") / F.col("vertices") >= dense), "edge_balanced").when(average >= high / 4, "hybrid").otherwise("vertex_balanced")
    got = got.withColumns({"average": average, "mode": mode})
    work = F.when(F.col("mode") == "vertex_balanced", F.col("vertices")).otherwise(F.greatest("vertices", "edges"))
    return got.withColumn("grain", F.greatest(F.lit(1), F.ceil(work / (workers * 8))).cast("long")).drop("_high")


def intersection_method(size_a: Column, size_b: Column, last_a: Column, last_b: Column, vector: int = 32) -> Column:
    """bitmap for dense ids, galloping for lopsided sizes, vector for long lists, else merge."""
    small, large, both = F.least(size_a, size_b), F.greatest(size_a, size_b), size_a + size_b
    return (
        F.when(small == 0, "merge")
        .when((both >= 1024) & (F.greatest(last_a, last_b) <= both * 8), "bitmap")
        .when(large > 16 * small, "galloping")
        .when(small >= vector, "vector")
        .otherwise("merge")
    )


def intersection_size(a: Column, b: Column) -> Column:
    """Common elements of two arrays of distinct ids."""
    return F.size(F.array_intersect(a, b))


def partition_ranges(df: DataFrame, n: str, parts: str) -> DataFrame:
    """Explode rows into (part, begin, end): contiguous ranges of n items in at most n, at least one, parts."""
    p = F.greatest(F.lit(1), F.least(F.col(parts), F.col(n)))
    rows = df.withColumn("_p", p).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("_p") - 1).cast("int"))))
    at = lambda k: F.floor(F.col(n) * k / F.col("_p")).cast("long")
    return rows.withColumns({"begin": at(F.col("part")), "end": at(F.col("part") + 1)}).drop("_p")
