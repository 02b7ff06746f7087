"""Common neighbours, Jaccard similarity and triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import fixpoint
from .graph import degrees


def common_neighbors(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common): vertices adjacent to both ends of each pair."""
    left = pairs.join(arcs.withColumnRenamed("src", "a").withColumnRenamed("dst", "x"), "a")
    both = left.join(arcs.withColumnRenamed("src", "b").withColumnRenamed("dst", "x"), ["b", "x"])
    found = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return pairs.distinct().join(found, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def jaccard(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard); 0 where neither end has a neighbour."""
    return with_jaccard(arcs, common_neighbors(arcs, pairs))


def with_jaccard(arcs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, common, jaccard) of (a, b, common)."""
    deg = degrees(arcs)
    for end in ("a", "b"):
        rows = rows.join(deg.select(F.col("v").alias(end), F.col("degree").alias(f"_{end}")), end, "left")
    union = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)) - F.col("common")
    return rows.select("a", "b", "common", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"))


def oriented_by_degree(arcs: DataFrame) -> DataFrame:
    """(src, dst, degree of dst): each undirected edge from its end of lower (degree, id): no vertex keeps more than O(sqrt(edges)) of them, hubs included."""
    deg = degrees(arcs)
    rows = arcs.where("src < dst").join(deg.select(F.col("v").alias("src"), F.col("degree").alias("_s")), "src").join(deg.select(F.col("v").alias("dst"), F.col("degree").alias("_d")), "dst")
    up = F.col("_s") <= F.col("_d")
    return rows.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"), F.greatest("_s", "_d").alias("degree"))


def triangles(arcs: DataFrame) -> DataFrame:
    """(a, b, c) once per triangle, in the order of degree; of two arcs from a, only the pair in that order is looked up."""
    o = fixpoint.cut(oriented_by_degree(arcs))
    wedges = o.toDF("a", "b", "_b").join(o.toDF("a", "c", "_c"), "a").where("_b < _c or (_b = _c and b < c)").select("a", "b", "c")
    return wedges.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def adjacent_common(arcs: DataFrame) -> DataFrame:
    """(a, b, common) of all adjacent pairs a < b, counted from the triangles: each gives one to its three edges."""
    sides = F.array(*(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
    found = triangles(arcs).select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("common"))
    pairs = arcs.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def triangle_count(arcs: DataFrame) -> DataFrame:
    return triangles(fixpoint.cut(arcs)).agg(F.count(F.lit(1)).alias("triangles"))


def triangle_delta(arcs: DataFrame, changed: DataFrame) -> int:
    """Triangles of ``arcs`` that hold at least one edge of ``changed`` (both orientations, all of them in ``arcs``).

    Summed over the changed edges, common neighbours count a triangle once per changed edge of its own; those with two and
    three of them are taken off again.
    """
    once = changed.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))

    def total(x: DataFrame, y: DataFrame) -> int:
        rows = once.join(x.toDF("a", "x"), "a").join(y.toDF("b", "x"), ["b", "x"])
        return rows.count()

    one = total(arcs, arcs)
    if not one:
        return 0
    two = total(changed, arcs) + total(arcs, changed)
    three = total(changed, changed)
    # A triangle with k changed edges is in one k times, in two k(k - 1) times and in three k times if k = 3.
    return one - two // 2 + three // 3
