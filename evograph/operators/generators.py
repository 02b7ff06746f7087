"""Deterministic graphs as edge tables (src, dst), by arithmetic on ranges and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def uniform(n: int, *parts) -> Column:
    """A number in 0 to n - 1 from the first 48 bits of the md5 of the parts, joined by colons; other engines can draw the same."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(n).cast("long")


def grid_with_shortcuts(spark: SparkSession, side: int, seed: int = 1) -> DataFrame:
    """A torus whose vertices have arcs to their four neighbours, with a quarter as many long shortcuts as vertices; directed."""
    n = side * side
    v = spark.range(n).select(F.col("id").alias("src"), F.floor(F.col("id") / side).alias("r"), (F.col("id") % side).alias("c"))
    right, down = F.col("r") * side + (F.col("c") + 1) % side, (F.col("r") + 1) % side * side + F.col("c")
    edges = v.select("src", F.explode(F.array(right, down)).alias("dst"))
    long = spark.range(n // 4).select(uniform(n, seed, "a", F.col("id")).alias("src"), uniform(n, seed, "b", F.col("id")).alias("dst"))
    return schema.symmetric(edges).unionByName(long).where("src <> dst").distinct()


def ring_lattice(spark: SparkSession, n: int, reach: int = 4, seed: int = 1) -> DataFrame:
    """Each vertex next to the ``reach`` that follow it, and one random chord a vertex; undirected, one orientation."""
    near = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k")).select("src", ((F.col("src") + F.col("k")) % n).alias("dst"))
    chords = spark.range(n).select(F.col("id").alias("src"), uniform(n, seed, F.col("id")).alias("dst"))
    return near.unionByName(chords).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def chain_with_hubs(spark: SparkSession, n: int, hubs: int = 8, seed: int = 1) -> DataFrame:
    """A chain in both directions, hubs that reach every so many vertices, and long edges; directed."""
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    spokes = spark.range(n).where(F.col("id") % 16 == 0).select((F.col("id") % hubs).alias("src"), F.col("id").alias("dst"))
    long = spark.range(n // 8).select(uniform(n, seed, "a", F.col("id")).alias("src"), uniform(n, seed, "b", F.col("id")).alias("dst"))
    return schema.symmetric(chain).unionByName(spokes).unionByName(long).where("src <> dst").distinct()


def block_communities(spark: SparkSession, blocks: int, size: int, inside: int = 4, seed: int = 1) -> DataFrame:
    """Communities with an anchor each, random inner edges and bridges between neighbouring anchors; undirected, one orientation."""
    v = spark.range(blocks * size).select(F.col("id").alias("src"), (F.floor(F.col("id") / size) * size).alias("base"))
    inner = v.select("src", "base", F.explode(F.sequence(F.lit(1), F.lit(inside))).alias("k")).select("src", (F.col("base") + uniform(size, seed, F.col("src"), F.col("k"))).alias("dst"))
    anchors = v.select("src", F.col("base").alias("dst"))
    bridges = spark.range(blocks).select((F.col("id") * size).alias("src"), ((F.col("id") + 1) % blocks * size).alias("dst"))
    every = inner.unionByName(anchors).unionByName(bridges).where("src <> dst")
    return every.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def layered_diamonds(spark: SparkSession, layers: int, width: int) -> DataFrame:
    """From each diamond's tip to all of its middle, and on to the next tip; directed."""
    step = width + 1
    tips = spark.range(layers).select((F.col("id") * step).alias("t"), F.explode(F.sequence(F.lit(1), F.lit(width))).alias("k"))
    return tips.select(F.col("t").alias("src"), (F.col("t") + F.col("k")).alias("dst")).unionByName(tips.select((F.col("t") + F.col("k")).alias("src"), (F.col("t") + step).alias("dst")))


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 1, quadrants: tuple[float, float, float] = (0.57, 0.19, 0.19)) -> DataFrame:
    """Distinct edges of recursive quadrant draws, loops dropped; each bit of an edge is drawn by a hash of its own."""
    a, b, c = quadrants
    rows = spark.range(edges).select("id", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    for bit in range(scale):
        u = uniform(1 << 30, seed, bit, F.col("id")) / float(1 << 30)
        rows = rows.withColumn("_u", u).select("id", (F.col("src") * 2 + F.when(F.col("_u") >= a + b, 1).otherwise(0)).alias("src"), (F.col("dst") * 2 + F.when((F.col("_u") >= a) & (F.col("_u") < a + b) | (F.col("_u") >= a + b + c), 1).otherwise(0)).alias("dst"))
    return rows.where("src <> dst").select("src", "dst").distinct()


def splitmix64(x) -> np.ndarray:
    """The published generator's output for each 64-bit state (constants are fixed values)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permutation_order(df: DataFrame, column: str, seed: int = 1) -> DataFrame:
    """Rows in the order of splitmix64(value + seed), the key as ``_order`` shifted into the signed range; ties cannot occur, the function being a bijection."""

    def key(s: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(s.to_numpy().astype(np.uint64) + np.uint64(seed)) ^ np.uint64(1 << 63)).view(np.int64))

    key.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn("_order", F.pandas_udf(key, "long")(column)).orderBy("_order")


def circulant(spark: SparkSession, n: int, steps: tuple[int, ...] = (1, 7, 31)) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*((F.col("id") + s) % n for s in steps))).alias("dst")).where("src <> dst")


def stress_topologies(spark: SparkSession, n: int = 40, seed: int = 1) -> dict[str, DataFrame]:
    """Six shapes for long exactness runs."""
    v = spark.range(n).select(F.col("id").alias("src"))
    pairs = lambda k, top: v.select("src", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")).select("src", uniform(top, seed, F.col("src"), F.col("k")).alias("dst")).where("src <> dst")
    return {
        "random": pairs(2, n),
        "destructive": pairs(4, n),
        "disconnected": pairs(2, n // 4).select((F.col("src") % (n // 4) + F.floor(F.col("src") / (n // 4)) * (n // 4)).alias("src"), (F.col("dst") + F.floor(F.col("src") / (n // 4)) * (n // 4)).alias("dst")).where(f"src <> dst and dst < {n}"),
        "hub": v.where("src > 0").select(F.lit(0).cast("long").alias("src"), F.col("src").alias("dst")),
        "path": v.where(f"src < {n - 1}").select("src", (F.col("src") + 1).alias("dst")),
        "dense": pairs(n // 2, n),
    }
