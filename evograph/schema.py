"""Types, sentinels and checks shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest vertex id, which also stands for "unreachable" in results, and the infinite weighted distance.
UNREACHABLE = 4294967295
INFINITY = 4611686018427387903

UPDATES = "version long, seq long, src long, dst long, add boolean, ts long"
WEIGHTED_UPDATES = "version long, seq long, src long, dst long, weight long, add boolean, ts long"


def updates_frame(spark: SparkSession, rows: list[tuple], schema: str = UPDATES) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def vertices(spark: SparkSession, n: int) -> DataFrame:
    """All vertices 0 to n - 1, isolated ones included."""
    return spark.range(n).withColumnRenamed("id", "v")


def checked_id(c: Column) -> Column:
    """The id, or an error where it is outside 0 to 2^32 - 1."""
    return F.when((c >= 0) & (c <= UNREACHABLE), c).otherwise(F.raise_error(F.concat(F.lit("vertex id out of range: "), c.cast("string"))).cast("long"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both orientations of (src, dst, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def simple_arcs(edges: DataFrame, directed: bool) -> DataFrame:
    """The simple graph of an edge table: loops dropped, duplicates collapsed, undirected edges in both orientations."""
    kept = edges.select("src", "dst").where("src <> dst")
    return (kept if directed else symmetric(kept)).distinct()


def pair_key(directed: bool) -> tuple[Column, Column]:
    """Columns that name an edge: the pair itself, or its smaller and larger end."""
    return (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))


def undirected_only(directed: bool, what: str) -> None:
    if directed:
        raise ValueError(f"{what} needs an undirected graph")
