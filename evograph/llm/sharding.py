"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

A row's number is its rank in a total order of the rows.  A generalised Feistel network permutes
the numbers: for N rows it works on pairs (l, r) of Z_a x Z_b with a = ceil(sqrt N) and
b = ceil(N / a), and positions at or above N are walked along their cycle until they fall below N.
Position p lies in shard p mod n at slot p div n, so shards differ by at most one row, and both are
computable from a row's number, N and the seed alone.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

PRIME = 2**31 - 1
ROUNDS = 8
#: Steps of a walk that every row takes.  Fewer than a positions lie outside, so walks end within a steps; a row that needs more
#: than this many, which is possible only for N > 4,000, takes the rest by itself.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    rng = random.Random(f"feistel:{seed}")
    return [tuple(rng.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permute_number(x: int, n: int, seed: int) -> int:
    """The same permutation in plain Python, for callers who need one row's place."""
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for k, (p, q, c) in enumerate(round_keys(seed)):
            t = (right + p) % PRIME * q % PRIME
            left, right = right, (left + (t * t + c) % PRIME) % (b if k % 2 else a)
        x = left * b + right
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int) -> Column:
    """Column form of :func:`permute_number` for numbers 0 to n - 1."""
    a, b = sides(n)
    keys = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit(c).cast("long").alias("c"), F.lit(b if k % 2 else a).cast("long").alias("m")) for k, (p, q, c) in enumerate(round_keys(seed))))

    def mixed(right: Column, k: Column) -> Column:
        t = F.transform(F.array((right + k.p) % PRIME * k.q % PRIME), lambda v: (v * v + k.c) % PRIME)
        return t[0]

    def once(value: Column) -> Column:
        start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("left"), (value % b).alias("right"))
        return F.aggregate(keys, start, lambda s, k: F.struct(s.right.alias("left"), ((s.left + mixed(s.right, k)) % k.m).alias("right")), lambda s: s.left * b + s.right)

    def walk(start: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), steps), start, lambda at, i: F.when(at >= n, once(at)).otherwise(at))

    most = a * b - n + 1
    walked = walk(once(x), F.lit(max(1, min(WALK, most) - 1)))
    # One element, so that the first walk is evaluated once; the length depends on the row, so that it isn't folded to a long literal.
    return F.transform(F.array(walked), lambda at: F.when(at < n, at).otherwise(walk(at, F.when(at >= n, F.lit(max(1, most - WALK + 1))).otherwise(F.lit(1)))))[0]


def row_numbers(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` (0 to N - 1 by ``order_by``, nulls first) and N.

    Rows are range-partitioned once and written; each part's count, one row a part, gives its offset.
    Rows equal in every ordering column go to several parts by a seeded random last key, so
    copies of one row don't meet in one task; their numbers are interchangeable.
    """
    spark = df.sparkSession
    parts = common.shuffle_partitions(spark)
    ranged = df.withColumn("_tie", F.rand(11)).repartitionByRange(parts, *order_by, "_tie").withColumn("_part", F.spark_partition_id())
    ranged = common.materialize(ranged, "row_numbers")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order_by, "_tie")
    numbered = ranged.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("row_number", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_part", "_tie", "_at", "_before"), ranged.count()


def feistel_shards(df: DataFrame, order_by: list[str], n_shards: int = 16, seed: int = 20240917) -> DataFrame:
    """Add ``row_number``, ``position``, ``shard`` and ``slot``; shards hold equally many rows, one more at most.

    Null ordering values come first, repeated rows take neighbouring numbers, and an empty table
    stays empty.  Columns of ``df`` named like the added ones are replaced.
    """
    added = ["row_number", "position", "shard", "slot", "_part", "_tie", "_at", "_before", "_n"]
    df = df.drop(*(c for c in added if c not in order_by))
    numbered, n = row_numbers(df, order_by)
    if not n:
        return numbered.withColumns({"position": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    placed = numbered.withColumn("position", permuted(F.col("row_number"), n, seed))
    return placed.withColumns({"shard": (F.col("position") % n_shards).cast(T.IntegerType()), "slot": F.floor(F.col("position") / n_shards).cast("long")})


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents into shards 0 to 15 under the law ``rows``, numbered by (doc_id, size, text_crc32)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = feistel_shards(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
