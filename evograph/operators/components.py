"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import fixpoint


def min_labels(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex of each vertex's component; ``arcs`` hold both orientations or either.

    Large stars hang every larger neighbour on the smallest one, small stars do so for smaller
    ones; rounds grow with the logarithm of a component's diameter, and no neighbourhood is collected.
    """
    edges = fixpoint.cut(arcs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("p")).where("u <> p").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("p").alias("u"), F.col("u").alias("p")))
        least = both.groupBy("u").agg(F.min("p").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("p > u").select(F.col("p").alias("u"), F.col("m").alias("p")).where("u <> p").distinct()
        low = large.groupBy("u").agg(F.min("p").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("p")), F.struct(F.col("p").alias("u"), F.col("m").alias("p")))).alias("e"))
        edges = fixpoint.cut(small.select("e.*").where("u <> p").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "p"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return vertices.join(edges.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("p", "v").alias("component"))


def connected_components(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component) with dense numbers from 0 in the order of each component's smallest vertex."""
    labels = min_labels(arcs, vertices)
    roots = labels.where("v = component").select("component")
    numbered = dense_numbers(roots, "component").withColumnRenamed("number", "dense")
    return labels.join(numbered, "component").select("v", F.col("dense").alias("component"))


def dense_numbers(ids: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct ids numbered from 0 in ascending order, through counts of id ranges rather than one task."""
    width = 1 << 16
    ids = ids.select(column).distinct().withColumn("_r", F.floor(F.col(column) / width))
    counts = ids.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(column)) - 1
    return ids.withColumn("_at", inside).join(starts, "_r").select(column, (F.col("_start") + F.col("_at")).cast("long").alias("number"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
