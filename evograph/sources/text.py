"""Text edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import Graph


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a file or folder, numbered from 1 by file name and position.

    Lines are numbered within the parts that Spark reads, and a part's count, one row each, sets where the next one starts.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    from pyspark.sql.window import Window

    parts = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = parts.select("_f", "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m"))
    return rows.withColumn("_i", inside).join(F.broadcast(starts), ["_f", "_b"]).select((F.col("_s") + F.col("_i")).cast("long").alias("line"), "value")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """(line, src, dst): blank lines and those that start with # or % are skipped; anything else must be two ids below 2^32.

    Errors name the line and are raised as rows are read.
    """
    text = F.ltrim(F.regexp_replace("value", r"^[\t\r\f\x0B ]+", ""))
    rows = numbered_lines(spark, path).select("line", text.alias("t")).where("t <> '' and t not rlike '^[#%]'")
    parts = F.regexp_extract_all("t", F.lit(r"(\S+)"), 1)

    def bad(why: str):
        return F.raise_error(F.concat(F.lit(f"edge list: {why} at line "), F.col("line").cast("string")))

    def number(c):
        value = F.expr(f"try_cast({c} as decimal(38,0))")
        return F.when(~F.col(c).rlike(r"^[+-]?[0-9]+$"), bad("not a number").cast("long")).when(value.isNull() | (value < 0) | (value > schema.UNREACHABLE), bad("vertex id overflow").cast("long")).otherwise(value.cast("long"))

    rows = rows.select("line", parts.alias("p")).withColumn("p", F.when(F.size("p") < 2, bad("missing column").cast("array<string>")).when(F.size("p") > 2, bad("trailing data").cast("array<string>")).otherwise(F.col("p")))
    rows = rows.select("line", F.element_at("p", 1).alias("a"), F.element_at("p", 2).alias("b"))
    return rows.select("line", number("a").alias("src"), number("b").alias("dst"))


def load_edge_list(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return Graph.from_edges(read_strict(spark, path).select("src", "dst"), directed)


def read_lenient(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """(pos, src, dst[, weight]): # lines and rows that don't parse are skipped, further columns ignored; loops, duplicates and order stay."""
    rows = numbered_lines(spark, path).where("ltrim(value) not like '#%'").select("line", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p"))
    names = ["src", "dst", "weight"][:columns]
    got = rows.select(F.col("line").alias("pos"), *(F.expr(f"try_cast(try_element_at(p, {k + 1}) as bigint)").alias(n) for k, n in enumerate(names)))
    return got.where(" and ".join(f"{n} between 0 and {schema.UNREACHABLE}" if n != "weight" else "weight >= 0" for n in names))


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    return read_lenient(spark, path, 3)


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """(pos, add, src, dst) of lines ``a src dst`` and ``d src dst``."""
    rows = numbered_lines(spark, path).select("line", F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) = 3 and p[0] in ('a', 'd')")
    return rows.select(F.col("line").alias("pos"), (F.col("p")[0] == "a").alias("add"), F.expr("try_cast(p[1] as bigint)").alias("src"), F.expr("try_cast(p[2] as bigint)").alias("dst")).where("src is not null and dst is not null")
